"""Runs of a stream over a table that arrives slice by slice, and the result as a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.written import fresh_path

#: State in files of the executors, with snapshots in the checkpoint: needed for timers, and for state beyond memory.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Rows of a slice that one task writes, and rows of the table for each partition of state: a store of its own files for each trigger, so few rows are few stores.
SLICE_ROWS, STATE_ROWS = 1 << 18, 1 << 17
STORES = "spark.sql.shuffle.partitions"


def instant(wall: str) -> Column:
    """A timestamp without a zone as an instant, as if its zone were UTC: watermarks need one, whatever the session's zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {wall}))")


def wall(instant: str) -> Column:
    """The inverse of instant."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), timestamp_ntz'1970-01-01 00:00:00')")


@dataclass
class Replay:
    """rows: all that the stream gave; dropped: rows of state operators that came behind the watermark; triggers: batches that ran."""

    rows: DataFrame
    dropped: int
    triggers: int


def replayed(table: DataFrame, arrival: str, query: Callable[[Callable[[], DataFrame]], DataFrame], name: str) -> Replay:
    """query over a stream to which table's rows come in slices, by ascending ``arrival`` (a column, which the stream lacks).

    After each slice the stream runs to its end and stops, and the next run goes on from its checkpoint: each trigger sees
    the watermark of the slices before it. query gets a function that opens the stream, once for each time it is
    read. Append mode: rows that the last watermark doesn't close stay open. Slices are written once, by Spark, in tasks of bounded
    rows, and the driver knows their numbers only; rows of null arrival never come. State has the session's shuffle partitions, fewer for few rows.
    """
    spark = table.sparkSession
    folder = fresh_path(spark, name)
    total = table.count()
    part = F.floor(F.rand(1) * (1 + total // SLICE_ROWS))
    table.where(F.col(arrival).isNotNull()).repartition(arrival, part).write.partitionBy(arrival).parquet(f"{folder}/slices")
    slices = spark.read.schema(table.schema).parquet(f"{folder}/slices")
    schema = table.drop(arrival).schema
    names = [f"`{c}`" for c in schema.fieldNames()]
    dropped = triggers = 0
    kept = None
    stores = spark.conf.get(STORES)
    spark.conf.set(STORES, min(int(stores), 1 + total // STATE_ROWS))  # a stream keeps the number of its first run
    try:
        for row in slices.select(arrival).distinct().orderBy(arrival).collect():
            slices.where(F.col(arrival) == F.lit(row[0])).select(*names).write.mode("append").parquet(f"{folder}/inbox")
            stream = query(lambda: spark.readStream.schema(schema).parquet(f"{folder}/inbox"))
            kept = stream.schema
            run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            for progress in run.recentProgress:
                triggers += 1
                dropped += sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    finally:
        spark.conf.set(STORES, stores)
    if kept is None:
        return Replay(spark.createDataFrame([], query(lambda: table.drop(arrival)).schema), 0, 0)
    return Replay(spark.read.schema(kept).parquet(f"{folder}/out"), dropped, triggers)
