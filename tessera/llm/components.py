"""Connected components by alternating large-star and small-star steps, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Edges that a file of a round holds at least, on average: few edges are few files and tasks, many keep their partitions.
FILE_EDGES = 1 << 17


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node that is reachable) of every node of edges (a, b: long, both not null).

    Each round is a written table, so lineage stays short and a lost executor costs a task. Minima are taken before
    the shuffle, and what a hub's many edges are joined with is one row, so that adaptive execution can split them.
    Repeated edges and loops do no harm; an empty input gives no rows.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = written(ordered, "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(down, "hi")
        small = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(down.select("hi", F.col("m").alias("lo"))).distinct()
        now = written(small.coalesce(8 + state[0] // FILE_EDGES), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node but the roots has one edge, to its root.
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
