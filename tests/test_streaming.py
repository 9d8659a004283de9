"""Streams against the same rows in batch."""

import datetime as dt
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.plans.streams import late_arrivals
from tessera.streaming import idle_users, late_window_totals, pairs_or_alone
from tessera.streaming.replay import PROVIDER, STORES
from tessera.streaming.timers import IdleUsers

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def files(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tumbling_windows(spark, files):
    got = streaming.finished(streaming.windowed_counts(streaming.stream(spark, files), "1 day").select("start", "n"), "complete", "tumbling")
    batch = spark.read.parquet(files).withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(got) == rows(streaming.windowed_counts(batch, "1 day").select("start", "n"))


def test_sessions_are_those_of_the_batch_but_for_open_ones(spark, files):
    got = set(rows(streaming.finished(streaming.session_counts(streaming.stream(spark, files), "6 hours"), "append", "sessions")))
    batch = spark.read.parquet(files).withColumn("ts", F.col("ts").cast("timestamp"))
    every = set(rows(streaming.session_counts(batch, "6 hours")))
    assert got <= every and len(every) - len(got) < 20


def test_repeated_rows_are_dropped(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.unionAll(events).repartition(2).write.parquet(str(tmp_path / "twice"))
    got = streaming.finished(streaming.deduplicated(streaming.stream(spark, str(tmp_path / "twice"), "60 days"), ["event_id"]).select("event_id"), "append", "once")
    assert got.count() == events.count()


def test_interval_pairs(spark, files):
    left, right = streaming.stream(spark, files), streaming.stream(spark, files)
    got = streaming.finished(streaming.interval_pairs(left, right, "1 hour"), "append", "pairs")
    batch = spark.read.parquet(files)
    assert rows(got) == rows(streaming.interval_pairs(batch, batch, "1 hour"))


def test_custom_state(spark, files):
    got = streaming.finished(streaming.running_totals(streaming.stream(spark, files)), "update", "totals")
    last = got.groupBy("user_id").agg(F.max("n").alias("n"))
    assert rows(last) == rows(spark.read.parquet(files).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


def test_replay_drops_late_rows_and_counts_them(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    found = late_window_totals(late_arrivals(events), "arrival", "1 hour", "12 hours")
    assert found.dropped > 0 and found.triggers >= 7
    seen, all_ = found.rows.agg(F.sum("n")).first()[0], events.count()
    assert all_ - seen >= found.dropped  # the rest are in windows that are still open


def test_rows_in_order_are_never_late(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("arrival", F.dayofmonth("ts") % 32)
    found = late_window_totals(events, "arrival", "1 day", "1 hour")
    batch = {r["w"]: r["n"] for r in events.groupBy(F.window("ts", "1 day").alias("x")).count().select(F.col("x.start").alias("w"), F.col("count").alias("n")).collect()}
    got = {r["w"]: r["n"] for r in found.rows.collect()}
    assert found.dropped == 0 and got == {w: n for w, n in batch.items() if w in got} and len(got) == len(batch) - 1


def test_replay_does_not_depend_on_the_session_zone(spark):
    events = late_arrivals(spark.read.parquet(f"{DATA}/events.parquet").where("event_id < 300"))
    there = {}
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        there[zone] = sorted(map(tuple, late_window_totals(events, "arrival", "1 hour", "12 hours").rows.select(F.col("w").cast("string"), "n").collect()))
    assert there["UTC"] == there["America/New_York"] and len(there["UTC"]) > 50


def test_replay_of_no_rows(spark):
    events = late_arrivals(spark.read.parquet(f"{DATA}/events.parquet").limit(0))
    found = late_window_totals(events, "arrival", "1 hour", "12 hours")
    assert found.rows.count() == 0 and found.dropped == 0 and found.triggers == 0


def minutes(rows, arrivals):
    return [(i, u, kind, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), a) for i, ((u, kind, m), a) in enumerate(zip(rows, arrivals, strict=True))]


def test_idle_users_are_closed_by_a_timer_or_by_their_next_row(spark):
    rows = [(1, "a", 0), (1, "b", 5), (2, "a", 6), (1, "a", 40), (3, None, 41), (3, None, 41), (None, "a", 42), (2, "c", 300), (4, "a", 600)]
    table = spark.createDataFrame(minutes(rows, [0, 0, 0, 1, 1, 1, 1, 2, 3]), "event_id long, user_id long, event_type string, ts timestamp_ntz, arrival int")
    found = idle_users(table, "arrival", 10 * 60, "1 minute")
    base = 1704067200
    got = sorted(((r["user_id"], (r["start"] // 1_000_000 - base) // 60, (r["stop"] // 1_000_000 - base) // 60, r["n"], r["kinds"], r["ids"]) for r in found.rows.collect()), key=repr)
    # User 4 is open at the end; all others are closed, those without a later row by their timers.
    assert got == sorted([(1, 0, 5, 2, 2, [0, 1]), (1, 40, 40, 1, 1, [3]), (2, 6, 6, 1, 1, [2]), (2, 300, 300, 1, 1, [7]), (3, 41, 41, 2, 0, [4, 5]), (None, 42, 42, 1, 1, [6])], key=repr)


class CountedState:
    """A handle and its list state in memory, which count their calls; other kinds of state there are none."""

    def __init__(self):
        self.calls, self.rows, self.timers, self.now = 0, [], [], 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: bool(self.rows), "get": lambda: iter(self.rows), "clear": lambda: self.put([]), "put": lambda rows: setattr(self, "rows", rows), "listTimers": lambda: iter(self.timers),
            "registerTimer": self.timers.append, "deleteTimer": self.timers.remove, "getCurrentWatermarkInMs": lambda: self.now,
        }[name]


def test_calls_of_the_state_do_not_grow_with_users_and_activities():
    found = {}
    for users in (10, 1000):
        state, idle = CountedState(), IdleUsers(10)
        idle.init(state)
        rows = pd.DataFrame([(False, u, t, u * 10 + t, "a") for u in range(users) for t in (0, 5, 100, 200 + u % 2 * 2000)], columns=["nobody", "user", "us", "event_id", "event_type"])
        early = pd.concat(idle.handleInputRows((0,), iter([rows[::2], rows[1::2]]), state))
        assert len(early) == 2 * users and early["n"].sum() == 3 * users and early["ids"].map(list).tolist()[:2] == [[0, 5], [100]] and len(state.rows) == users
        assert state.timers == [1]
        state.now = 1
        late = pd.concat(idle.handleExpiredTimer((0,), state, None))
        assert late["user_id"].tolist() == list(range(0, users, 2)) and state.timers == [3] and len(state.rows) == users // 2
        found[users] = state.calls
    assert found[1000] == found[10] < 20


def test_an_activity_goes_on_from_trigger_to_trigger(spark):
    rows = [(1, "a", 0), (1, "b", 8), (1, "a", 16), (1, "a", 24), (2, "z", 100)]
    table = spark.createDataFrame(minutes(rows, [0, 1, 2, 3, 4]), "event_id long, user_id long, event_type string, ts timestamp_ntz, arrival int")
    assert [(r["user_id"], r["n"], r["kinds"], r["ids"]) for r in idle_users(table, "arrival", 10 * 60, "1 minute").rows.collect()] == [(1, 4, 2, [0, 1, 2, 3])]
    assert "RocksDB" not in spark.conf.get(PROVIDER[0])


def test_outer_join_releases_rows_without_partner(spark):
    rows = [(1, "p", 0), (1, "c", 30), (2, "p", 10), (1, "c", 45), (1, "p", 400), (2, "c", 401)]
    table = spark.createDataFrame(minutes(rows, [0, 0, 0, 1, 2, 2]), "event_id long, user_id long, event_type string, ts timestamp_ntz, arrival int")
    got = pairs_or_alone(table.where("event_type = 'p'"), table.where("event_type = 'c'"), "arrival", "1 hour", "10 minutes").rows.collect()
    assert sorted(map(tuple, got), key=repr) == [(0, 1), (0, 3), (2, None)]  # the purchase of minute 400 may still find one


def test_slices_are_dealt_over_tasks_and_few_rows_have_few_stores(spark, monkeypatch):
    monkeypatch.setattr("tessera.streaming.replay.SLICE_ROWS", 50)
    before = spark.conf.get(STORES)
    rows = [(i % 7, "p" if i % 2 else "c", i) for i in range(400)]
    table = spark.createDataFrame(minutes(rows, [0] * 300 + [1] * 100), "event_id long, user_id long, event_type string, ts timestamp_ntz, arrival int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few bytes are one task again
    try:
        found = pairs_or_alone(table.where("event_type = 'p'"), table.where("event_type = 'c'"), "arrival", "1 hour", "10 minutes").rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = Path(found.inputFiles()[0].removeprefix("file://")).parent.parent
    assert all(len(list((folder / "slices" / f"arrival={a}").glob("*.parquet"))) > 1 for a in (0, 1))
    assert sum(x.name.isdigit() for x in (folder / "state/state/0").iterdir()) == 1 and spark.conf.get(STORES) == before
