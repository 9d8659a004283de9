"""Transitive closure of directed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.written import written_table


def closure(links: DataFrame, rounds: int = 64) -> DataFrame:
    """src, dst, hops: every node that another leads to, and by how many links at least, of links (src, dst).

    Semi-naive, by doubling: a round joins only the pairs that are new since the last one with those known, on either side, so
    paths of 2^k links are complete after k rounds and no pair is derived from old ones again. A pair counts as new too
    if it was found with fewer hops than before. Each round's new pairs are a written table. A cycle makes its nodes lead
    to themselves. Links with a null end lead nowhere, repeated links count once, an empty table gives no rows. If paths
    are longer than ``rounds`` doublings reach, the job fails and gives no part of the answer.
    """
    fewest = lambda df: df.groupBy("src", "dst").agg(F.min("hops").alias("hops"))
    start = links.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("hops", F.lit(1))
    new = written_table(start, "closure")
    known = new
    for _ in range(rounds):
        if new.isEmpty():
            return known
        # src -> mid -> dst: new then known, and known then new. The middle is what both sides are dealt by.
        first = new.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h1"))
        last = known.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"))
        ahead = first.join(last, "mid")
        first = known.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h1"))
        last = new.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"))
        found = fewest(ahead.unionByName(first.join(last, "mid")).select("src", "dst", (F.col("h1") + F.col("h2")).alias("hops")))
        old = known.withColumnRenamed("hops", "before")
        better = found.join(old, ["src", "dst"], "left").where("before is null or hops < before").drop("before")
        new = written_table(better, "closure")
        known = written_table(fewest(known.unionByName(new)), "closure-known")
    raise ValueError(f"paths go on after {rounds} doublings")
