"""Rows that come late: what a watermark drops, and what it releases unmatched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.replay import Replay, instant, replayed, wall


def late_window_totals(events: DataFrame, arrival: str, size: str, late: str) -> Replay:
    """w, n, v of windows of ``size`` over events (ts, value) that arrive out of order, in slices by ``arrival``.

    A window is closed once the watermark, the latest time of the slices before less ``late``, has passed its end; rows of closed windows are dropped and
    counted. Windows that stay open to the end are no rows.
    """

    def totals(read):
        rows = read().withWatermark("at", late)
        return rows.groupBy(F.window("at", size).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("x.start").alias("w"), "n", "v")

    found = replayed(events.select(instant("ts").alias("at"), "value", arrival), arrival, totals, "late")
    found.rows = found.rows.select(wall("w").alias("w"), "n", "v")
    return found


def pairs_or_alone(left: DataFrame, right: DataFrame, arrival: str, within: str, late: str) -> Replay:
    """a, b: rows of left (event_id, user_id, ts) with each row of right of the same user that follows by ``within`` at most, or with null.

    A left row without a partner is released once the smaller of both watermarks says that none can come. Both sides
    arrive in slices by ``arrival``; each side has a watermark of its own, ``late`` behind its latest row.
    """
    tagged = lambda df, side: df.select("event_id", "user_id", instant("ts").alias("at"), arrival, F.lit(side).alias("side"))

    def joined(read):
        a = read().where("side = 0").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("at").alias("ta")).withWatermark("ta", late)
        b = read().where("side = 1").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("at").alias("tb")).withWatermark("tb", late)
        return a.join(b, F.expr(f"ua = ub and tb >= ta and tb <= ta + interval {within}"), "left_outer").select("a", "b")

    return replayed(tagged(left, 0).unionByName(tagged(right, 1)), arrival, joined, "outer")
