"""As-of and range joins."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.written import written_table


#: Rows of one key from which an as-of join splits it into ranges of time; ranges of such a key (a square); hot keys broadcast.
HOT_ROWS, RANGES, FEW = 1 << 20, 1024, 1 << 10


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with the values of the last row of right of equal ``by`` whose ``at`` is not later; null if there is none.

    Both sides are stacked and sorted by key and time, and a window carries the last right row forward, so the work is
    one shuffle of both sides whatever the number of earlier rows; nothing is paired. A key of more than ``hot_rows``
    rows is split into ranges of time, each one group of the window: what a range inherits, the last right row before
    it, comes from a pass over one row for each range. Rows of one key and one time stay together. Of right rows of
    one time the largest values count. Rows of left with a null key or time find nothing and are not shuffled.
    """
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(k) for c, k in zip(by, names, strict=True)]
    known = reduce(and_, [F.col(c).isNotNull() for c in by], F.col(at).isNotNull())
    rows = left.where(known).select(*keys, F.col(at).alias("_at"), F.struct(*left.columns).alias("_row"))
    found = right.where(known).select(*keys, F.col(at).alias("_at"), F.struct(*[F.col(c).alias(out) for out, c in values.items()]).alias("_found"))
    hot = _hot_keys(rows.select(*names, "_at").unionAll(found.select(*names, "_at")), names, hot_rows)
    if hot is None:
        rows, found = (df.withColumn("_range", F.lit(0)) for df in (rows, found))
        carry = F.lit(None)
    else:
        found = _ranged(found, hot, names)
        hot = _small(written_table(_inherited(found, hot, names), "asof-inherited"))
        rows, carry = _ranged(rows, hot, names), F.get("_carries", F.col("_range"))
    sides = rows.withColumn("_side", F.lit(1)).unionByName(found.drop("_bounds").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*names, "_range").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    last = sides.withColumn("_last", F.last("_found", ignorenulls=True).over(order)).where("_side = 1").withColumn("_last", F.coalesce("_last", carry))
    types = found.schema["_found"].dataType
    lost = left.where(~known).select("*", *[F.lit(None).cast(types[out].dataType).alias(out) for out in values])
    return last.select("_row.*", *[F.col(f"_last.{out}").alias(out) for out in values]).unionByName(lost)


def _small(df: DataFrame) -> DataFrame:
    """A written table of hot keys, broadcast if there are few: each has RANGES times and rows. Many are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


def _hot_keys(times: DataFrame, names: list[str], hot_rows: int) -> DataFrame | None:
    """Keys of more than hot_rows rows with _bounds, the times at which their ranges but the first begin; None if there are none.

    Bounds are quantiles of a sketch that tasks merge, so no task reads a key's rows.
    """
    counts = written_table(times.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows), "asof-hot")
    if counts.isEmpty():
        return None
    cuts = [i / RANGES for i in range(1, RANGES)]
    sketch = times.join(_small(counts.select(*names)), names).groupBy(*names).agg(F.percentile_approx("_at", cuts, 8 * RANGES).alias("_cuts"))
    return _small(written_table(sketch.select(*names, F.array_sort(F.array_distinct("_cuts")).alias("_bounds")), "asof-bounds"))


def _ranged(df: DataFrame, hot: DataFrame, names: list[str]) -> DataFrame:
    """df with _range, the number of its key's bounds that are not later; 0 for keys that are not hot. Two looks at a root of the bounds each."""
    side = math.isqrt(RANGES)
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("_at")))
    joined = df.join(hot, names, "left")
    coarse = joined.withColumn("_coarse", upto(F.filter("_bounds", lambda _, i: i % side == side - 1)))
    fine = F.col("_coarse") * side + upto(F.slice("_bounds", F.col("_coarse") * side + 1, F.lit(side)))
    return coarse.withColumn("_range", F.coalesce(fine, F.lit(0))).drop("_coarse")


def _inherited(found: DataFrame, hot: DataFrame, names: list[str]) -> DataFrame:
    """hot with _carries: for each range of a key the last right row before it, from one row for each range that has any."""
    last = found.where("_bounds is not null").groupBy(*names, "_range").agg(F.max(F.struct("_at", "_found")).alias("_last"))
    each = last.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_range", "_last"))).alias("_lasts"))
    before = lambda r: F.get(F.filter("_lasts", lambda x: x["_range"] < r), F.size(F.filter("_lasts", lambda x: x["_range"] < r)) - 1)
    carries = F.transform(F.sequence(F.lit(0), F.size("_bounds")), lambda r: before(r)["_last"]["_found"])
    return hot.join(each, names, "left").select(*names, "_bounds", carries.alias("_carries"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, extra: Column | None = None) -> DataFrame:
    """Pairs of rows with low <= point <= high, by equality of buckets of ``width``.

    A range is repeated for each bucket that it covers, a point stands in one, so each pair is found once and the join
    is by hash or sort instead of a nested loop. width near the usual length of a range keeps copies few. Nulls pair
    with nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    placed = points.where(F.col(point).isNotNull()).withColumn("_bucket", bucket(point))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    return placed.join(spread, "_bucket").where(inside if extra is None else inside & extra).drop("_bucket")


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left whose key is NOT IN the other column of right, with SQL's rules for nulls.

    A null in right leaves no row; against an empty right all rows stay, those of null key included, and otherwise
    those go. Two counts of right decide it, so the join is an anti join by equality that shuffles like any other and
    broadcasts one row besides.
    """
    counts = right.agg(F.count(F.lit(1)).alias("_rows"), F.count(other).alias("_known"))
    absent = left.join(right.select(F.col(other).alias("_other")), F.col(key) == F.col("_other"), "left_anti")
    allowed = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_known")) & F.col(key).isNotNull())
    return absent.join(F.broadcast(counts)).where(allowed).select(*left.columns)
