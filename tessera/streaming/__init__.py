"""Structured Streaming forms of the event-time queries, state with timers, and runs over tables that arrive in slices."""

from tessera.streaming.events import deduplicated, finished, interval_pairs, running_totals, session_counts, stream, windowed_counts
from tessera.streaming.late import late_window_totals, pairs_or_alone
from tessera.streaming.replay import Replay, replayed
from tessera.streaming.timers import idle_users

__all__ = [
    "Replay", "deduplicated", "finished", "idle_users", "interval_pairs", "late_window_totals", "pairs_or_alone", "replayed", "running_totals", "session_counts", "stream", "windowed_counts",
]
