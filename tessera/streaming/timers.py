"""Keyed state with timers: activity of users, closed by an event-time timer once they are idle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.replay import PROVIDER, Replay, instant, replayed

OUT = "user_id long, start long, stop long, n long, kinds long, ids array<long>"

#: Of an event in state: ``nobody`` stands for a null user, whose ``user`` is 0, as pandas turns integers with nulls into floats.
TYPES = {"nobody": "bool", "user": "int64", "us": "int64", "event_id": "int64", "event_type": "object"}
COLUMNS = list(TYPES)


class IdleUsers(StatefulProcessor):
    """The open activities of a bucket of users: a list of their events, and a timer at the time when the first of them ends.

    An activity is open until its user's next one begins or its last time plus ``idle`` has passed; then it is given out and its events leave the list,
    so state holds users of the last ``idle`` and no others. Each trigger and timer reads and writes a bucket's list once, however many users
    it has: a call of the state for each user and activity costs more than all else.
    """

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "nobody boolean, user long, us long, event_id long, event_type string")

    def _events(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Open events and the rows of parts by user and time, with the number of their activity and whether it is its user's last."""
        known = pd.DataFrame(list(self.open.get()) if self.open.exists() else [], columns=COLUMNS)
        table = pd.concat([part[COLUMNS].astype(TYPES) for part in [known, *parts]], ignore_index=True).sort_values(["nobody", "user", "us", "event_id"], ignore_index=True)
        by = table.groupby(["nobody", "user"], sort=False)
        gap = by["us"].diff()
        table["activity"] = (gap.isna() | (gap > self.idle_us)).cumsum()
        table["last"] = table["activity"] == by["activity"].transform("last")
        return table

    def _ends(self, table: pd.DataFrame) -> np.ndarray:
        """For each row the millisecond in which its activity ends, rounded up."""
        stop = table.groupby("activity")["us"].transform("max").to_numpy(np.int64)
        return -(-(stop + self.idle_us) // 1000)

    def _given_out(self, table: pd.DataFrame) -> pd.DataFrame:
        by = table.groupby("activity", sort=True)
        found = by.agg(nobody=("nobody", "first"), user=("user", "first"), start=("us", "min"), stop=("us", "max"), n=("us", "size"), kinds=("event_type", "nunique"))
        at = np.cumsum(found["n"].to_numpy())[:-1]
        found["ids"] = pd.Series(np.split(table["event_id"].to_numpy(np.int64), at), index=found.index, dtype=object)
        found.insert(0, "user_id", found["user"].astype("Int64").mask(found["nobody"]))
        return found.drop(columns=["nobody", "user"]).reset_index(drop=True)

    def _keep(self, table: pd.DataFrame) -> None:
        """table's events are all that is open: they become the list, and the only timer stands where the first of them ends."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if table.empty:
            self.open.clear()
            return
        kinds = table["event_type"].astype(object).where(table["event_type"].notna(), None)
        self.open.put(list(zip(*[table[c].tolist() for c in COLUMNS[:-1]], kinds, strict=True)))
        self.handle.registerTimer(int(self._ends(table).min()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A bucket's rows of a trigger; ``buckets`` keeps them to a few thousand."""
        table = self._events(list(rows))
        closed = table[~table["last"]]
        if len(closed):
            yield self._given_out(closed)
        self._keep(table[table["last"]])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        table = self._events([])
        over = self._ends(table) <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            yield self._given_out(table[over])
        self._keep(table[~over])

    def close(self) -> None:
        pass


def idle_users(events: DataFrame, arrival: str, idle_seconds: int, late: str, rows_a_bucket: int = 1 << 13) -> Replay:
    """user_id, start, stop (microseconds since 1970), n, kinds, ids of activities: runs of a user's events (event_id, user_id, ts, event_type) without a gap of more than idle_seconds.

    An activity is given out when the user's next one begins or the watermark passes its end and idle_seconds. Rows
    of null user are an activity of their own user; rows behind the watermark are dropped. State is keyed by buckets of users,
    as many as keep about rows_a_bucket of all events in each; a user's rows are in one bucket.
    """
    spark = events.sparkSession
    buckets = 1 + events.count() // rows_a_bucket

    def closed(read):
        rows = read().withWatermark("at", late).withColumns({"us": F.unix_micros("at"), "nobody": F.isnull("user_id"), "user": F.coalesce("user_id", F.lit(0))})
        return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(IdleUsers(idle_seconds * 1_000_000), OUT, "Append", "EventTime")

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        return replayed(events.select("event_id", "user_id", "event_type", instant("ts").alias("at"), arrival), arrival, closed, "idle")
    finally:
        spark.conf.set(PROVIDER[0], before)
