"""Sketches that are built by part and merged: distinct counts and quantiles with bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a distinct-count sketch as a power of two; items of a quantile sketch's levels.
LOG_BUCKETS, LEVEL = 12, 200
#: Standard error of a merged distinct count, and the rank error that a quantile exceeds once in a hundred.
DISTINCT_ERROR, RANK_ERROR = 1.04 / math.sqrt(1 << LOG_BUCKETS), 0.0133


def sketched(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """by, keys and values (binary): sketches of the distinct keys and of the values of each group. Nulls do not count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, LOG_BUCKETS).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), LEVEL).alias("values"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones: no row is read again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values").alias("values"))


def distinct_estimate(keys: str) -> Column:
    return F.hll_sketch_estimate(keys)


def quantile_estimate(values: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))


def distinct_within(estimate: Column, exact: Column, sigmas: float = 4.0) -> Column:
    """Whether an estimate is as close to the exact count as it should be in all but one of 15000 cases."""
    return F.abs(estimate - exact) <= F.lit(sigmas * DISTINCT_ERROR) * exact + 1


def rank_within(below: Column, upto: Column, n: Column, q: float, times: float = 2.0) -> Column:
    """Whether a value that ``below`` of n values are smaller than, and ``upto`` are not larger than, has about rank q."""
    slack = F.lit(times * RANK_ERROR) * n + 1
    return (below - slack <= F.lit(q) * n) & (upto + slack >= F.lit(q) * n)
