"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of arcs (``cells``). Each shard owns ``replicas`` virtual nodes at hashed places; an arc
belongs to the first virtual node clockwise. Rows fall on the arc of their key's hash. An arc's rows that find
their shard full continue clockwise to the next shard that has room, so no shard exceeds its capacity.

At any size the walk around the ring works on the counts of the arcs (``cells`` numbers, a bound that does not grow
with the input) inside one SQL expression. Rows are touched twice: counted by arc before any shuffle, then ranked
within their arc. Arcs that hold a hot key are ranked in salted parts, so one key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ranked, unused


def ring_steps(spark: SparkSession, shards: int, cells: int, replicas: int) -> DataFrame:
    """cell, step, shard: the shards in the order in which they are met clockwise from the cell. cells * shards rows."""
    nodes = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
        .select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(cells)).cast("int").alias("at"))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_set("at")).alias("places"))
    )
    # Of each shard only the first virtual node clockwise counts.
    near = (
        nodes.select("shard", "places", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        .withColumn("next", F.get(F.filter("places", lambda p: p >= F.col("cell")), F.lit(0)))
        .withColumn("away", F.coalesce(F.col("next"), F.get("places", F.lit(0)) + cells) - F.col("cell"))
    )
    walk = Window.partitionBy("cell").orderBy("away", F.xxhash64("cell", "shard"), "shard")
    return near.select("cell", (F.row_number().over(walk) - 1).alias("step"), "shard")


def ring_runs(counts: DataFrame, shards: int, cells: int, replicas: int, slack: float = 0.0) -> DataFrame:
    """Which ranks of each arc go to which shard: cell, shard, first, stop, slot (of the first).

    counts: cell, n. With slack 0 shard i has room for floor or ceil of the mean, so that all are full in the end
    and counts differ by one at most; slack s gives room for (1 + s) times the mean, and fewer rows move when shards
    are added. Empty input gives no rows.
    """
    steps = ring_steps(counts.sparkSession, shards, cells, replicas).join(counts, "cell")
    # One row: cells * shards steps at most, whatever the input.
    ring = (
        steps.groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("cell", "step", "shard", F.col("n").cast("long").alias("n")))).alias("steps"), F.sum(F.when(F.col("step") == 0, F.col("n"))).alias("total"))
        .where("total > 0")
    )
    each = F.sequence(F.lit(0), F.lit(shards - 1))
    if slack > 0:
        room = F.transform(each, lambda i: F.ceil(F.col("total") * (1 + slack) / shards).cast("long"))
    else:
        room = F.transform(each, lambda i: F.expr(f"total div {shards}") + F.when(i < F.col("total") % shards, 1).otherwise(0))
    start = F.struct(
        room.cast("array<bigint>").alias("room"),
        F.array_repeat(F.lit(0).cast("long"), shards).alias("used"),
        F.lit(0).cast("long").alias("done"),
        F.array().cast("array<struct<cell:int,shard:int,first:bigint,stop:bigint,slot:bigint>>").alias("runs"),
    )

    def meet(state: Column, x: Column) -> Column:
        done = F.when(x["step"] == 0, F.lit(0).cast("long")).otherwise(state["done"])
        used = F.get(state["used"], x["shard"])
        take = F.least(x["n"] - done, F.get(state["room"], x["shard"]) - used)
        run = F.struct(x["cell"].alias("cell"), x["shard"].alias("shard"), done.alias("first"), (done + take).alias("stop"), used.alias("slot"))
        return F.struct(
            state["room"].alias("room"),
            F.when(take > 0, F.transform(state["used"], lambda u, i: u + F.when(i == x["shard"], take).otherwise(0))).otherwise(state["used"]).alias("used"),
            (done + take).alias("done"),
            F.when(take > 0, F.array_append(state["runs"], run)).otherwise(state["runs"]).alias("runs"),
        )

    return ring.select(F.explode(F.aggregate("steps", start, meet)["runs"]).alias("run")).select("run.*")


def shard_by_ring(df: DataFrame, key: Column, tie: list[Column], shards: int = 24, cells: int = 2048, replicas: int = 64, slack: float = 0.0) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard).

    key places a row on the ring (rows with equal keys stay together as far as room allows); tie orders the rows of
    an arc, and only rows equal in all of it are told apart arbitrarily. Null keys have a place like any other.
    The same rows give the same shards in any order and partitioning. Columns of df named shard or slot are replaced,
    unless key or tie need them; all others are kept, whatever their names.
    """
    results = ["shard", "slot"]
    cell, rank, at, low, high, run_shard, run_slot = unused(df, "_cell", "_rank", "_at", "_low", "_high", "_shard", "_slot")
    placed = df.withColumn(cell, F.pmod(F.xxhash64(F.lit("key"), key), F.lit(cells)).cast("int"))
    rows = ranked(placed, [cell], tie, F.xxhash64(*tie), rank=rank).drop(*results)
    counts = placed.groupBy(F.col(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    runs = ring_runs(counts, shards, cells, replicas, slack).select(F.col("cell").alias(at), F.col("first").alias(low), F.col("stop").alias(high), F.col("shard").alias(run_shard), F.col("slot").alias(run_slot))
    # At most cells + shards runs: a bound set by the parameters.
    joined = rows.join(F.broadcast(runs), (F.col(cell) == F.col(at)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    place = (F.col(run_slot) + F.col(rank) - F.col(low)).cast("long")
    return joined.withColumns({"shard": F.col(run_shard), "slot": place}).drop(cell, rank, at, low, high, run_shard, run_slot)


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: all rows, repeated ones included.

    Keyed by text, so copies share a shard until it is full. Null text: size 8 and the checksum of no bytes. Null
    ids are kept and rank first. Law ``rows``: counts of shards differ by one at most. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )
    tie = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    out = shard_by_ring(slim, F.col("_key"), tie, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
