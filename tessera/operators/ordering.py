"""Operators on ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group with their number; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """by, start, n: runs of rows of which none is ``gap`` or more after the one before."""
    window = F.session_window(at, gap)
    return df.groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), "n")
