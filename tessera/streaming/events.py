"""Event-time operators over a stream of the events table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream of the parquet files under path, with ts as an event time (ts without a zone can carry no watermark)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, size: str, step: str | None = None) -> DataFrame:
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key within the watermark; state for older keys is dropped."""
    return events.dropDuplicatesWithinWatermark(by)


def interval_pairs(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """Pairs of one user whose right event follows the left one by ``within`` at most; bounded state on both sides."""
    a = left.select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta"))
    b = right.select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb"))
    return a.join(b, F.expr(f"ua = ub and tb > ta and tb <= ta + interval {within}")).select("a", "b")


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total so far, one row for each user of each batch: a custom state in pandas."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def finished(query: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream gives for the files that are there now, as a table; for tests and backfills."""
    spark = query.sparkSession
    run = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)
