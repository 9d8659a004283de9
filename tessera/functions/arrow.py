"""Aggregates of one's own over Arrow arrays, and a table function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _logs(values: pa.Array, weights: pa.Array) -> tuple[float, float]:
    """Sums of weighted logarithms and of weights of the rows that count: value above 0, weight not null and not below 0."""
    use = pc.fill_null(pc.and_(pc.greater(values, 0.0), pc.greater_equal(weights, 0.0)), False)
    values, weights = values.filter(use), weights.filter(use)
    return pc.sum(pc.multiply(pc.ln(values), weights)).as_py() or 0.0, pc.sum(weights).as_py() or 0.0


@F.arrow_udf(ArrayType(DoubleType()))  # a type, as workers import this module and cannot parse its name
def _parts(values: pa.Array, weights: pa.Array) -> object:
    return list(_logs(values, weights))


@F.arrow_udf(DoubleType())
def geometric_mean_of_frame(values: pa.Array, weights: pa.Array) -> object:
    """The weighted geometric mean of a window's frame; null if no row of it counts."""
    total, weight = _logs(values, weights)
    return math.exp(total / weight) if weight > 0 else None


def weighted_geometric_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str, parts: int = 64) -> DataFrame:
    """by, out: the weighted geometric mean of each group's values, over those above 0 with a weight that is not null; null if none is.

    The Arrow function sees a group's rows by ``parts`` parts, dealt by a hash of value and weight and by task, and gives two sums of each part;
    sums of sums are Spark's own. So a group that holds most rows is many tasks' work, and memory is that of a part.
    """
    salt = F.pmod(F.xxhash64(value, weight, F.spark_partition_id()), F.lit(parts))
    logs = df.withColumn("_part", salt).groupBy(*by, "_part").agg(_parts(F.col(value).cast("double"), F.col(weight).cast("double")).alias("_s"))
    sums = logs.groupBy(*by).agg(F.sum(F.col("_s")[0]).alias("_t"), F.sum(F.col("_s")[1]).alias("_w"))
    return sums.select(*by, F.when(F.col("_w") > 0, F.exp(F.col("_t") / F.col("_w"))).alias(out))


def trailing_geometric_mean(df: DataFrame, by: list[str], order: list[str], value: str, weight: str, out: str, rows: int) -> DataFrame:
    """df with out: the weighted geometric mean of each row and the ``rows`` before it of its group."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, 0)
    return df.withColumn(out, geometric_mean_of_frame(F.col(value).cast("double"), F.col(weight).cast("double")).over(frame))


@F.udtf(returnType="key long, kind string, first_id long, last_id long, n long")
class Runs:
    """Runs of rows of equal kind within a key, in the order in which the partition comes; state is the open run alone."""

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        key, kind, number = row["key"], row["kind"], row["id"]
        if self.run and self.run[:2] == [key, kind]:
            self.run[3:] = [number, self.run[4] + 1]
            return
        if self.run:
            yield tuple(self.run)
        self.run = [key, kind, number, number, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def runs(df: DataFrame, key: str, order: list[str], kind: str, number: str) -> DataFrame:
    """key, kind, first_id, last_id, n: runs of rows of equal kind of each key by ``order``. Null kinds are equal to each other.

    Spark deals rows out by key and sorts them, the function holds one run. An empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(kind).alias("kind"), F.col(number).cast("long").alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return Runs(rows.asTable().partitionBy("key").orderBy(*[f"o{i}" for i in range(len(order))]))
