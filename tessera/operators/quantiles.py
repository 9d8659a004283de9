"""Exact quantiles of groups of any size, without a group in a task."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.written import written_table

#: Rows of a group that one task may sort; cells of a histogram; big groups whose bounds are broadcast.
SORTED_ROWS, CELLS, FEW = 1 << 16, 1024, 1 << 14


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """by, and each named quantile (double) of the values of a group, interpolated between its two neighbours in rank.

    Groups of up to ``sorted_rows`` values are sorted, many to a task. For all larger ones at once, a histogram of CELLS
    cells between bounds is counted before it is shuffled, the cell that holds the rank gives the next, closer bounds, and so on
    until at most ``sorted_rows`` values lie between them or all that do are equal: then these alone are sorted, or none. Cells are
    even steps of the value, or of its logarithm where bounds of one sign are far apart, so a few rounds do for any values.
    Nulls do not count; NaN is larger than all. A group without values has null quantiles; null keys are groups as in
    groupBy; an empty table gives no rows.
    """
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], F.col(value).cast("double").alias("_v"))
    sizes = written_table(rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-sizes")
    big = sizes.where(F.col("_n") > sorted_rows)
    n_big = big.count()
    found = _of_sorted(rows, sizes, big if n_big else None, n_big, names, quantiles)
    if n_big:
        found = found.unionByName(_of_big(rows, big, n_big, names, quantiles, sorted_rows))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, names, strict=True)], *quantiles)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    found = F.lit(True)
    for k in names:
        found = found & a[k].eqNullSafe(b[k])
    return found


def _hinted(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def _between(lower: Column, upper: Column, q: float, n: Column) -> Column:
    """The quantile q of n values from those of ranks floor((n - 1) q) and the next."""
    place = (n - 1) * F.lit(float(q))
    return F.when(F.floor(place) == place, lower).otherwise((F.ceil(place) - place) * lower + (place - F.floor(place)) * upper)


def _of_sorted(rows: DataFrame, sizes: DataFrame, big: DataFrame | None, n_big: int, names: list[str], quantiles: dict[str, float]) -> DataFrame:
    few = rows
    if big is not None:
        other = _hinted(big.select(*names).alias("big"), n_big)
        few = rows.join(other, _same(rows, other, names), "left_anti")
        sizes = sizes.join(other, _same(sizes, other, names), "left_anti")
    group = Window.partitionBy(*names)
    ranked = few.where("_v is not null").withColumns({"_r": F.row_number().over(group.orderBy("_v")) - 1, "_n": F.count("_v").over(group)})
    picks = []
    for i, q in enumerate(quantiles.values()):
        place = (F.col("_n") - 1) * F.lit(float(q))
        picks += [F.max(F.when(F.col("_r") == edge(place), F.col("_v"))).alias(f"_{side}{i}") for side, edge in (("a", F.floor), ("b", F.ceil))]
    values = ranked.groupBy(*names).agg(F.max("_n").alias("_n"), *picks)
    out = values.select(*names, *[_between(F.col(f"_a{i}"), F.col(f"_b{i}"), q, F.col("_n")).alias(name) for i, (name, q) in enumerate(quantiles.items())])
    void = sizes.where("_n = 0").select(*names, *[F.lit(None).cast("double").alias(name) for name in quantiles])
    return out.unionByName(void)


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """The cell of v between lo and hi (lo < hi, or NaN): monotone in v, so cells are runs of ranks. Halves keep differences finite."""
    last = F.lit(CELLS - 1)
    linear = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    of_log = (F.ln(F.abs(v)) - F.ln(small)) / (F.ln(large) - F.ln(small))
    of_log = F.when(lo > 0, of_log).otherwise(1 - of_log)
    inf = float("inf")
    step = lambda share: F.greatest(F.lit(1), F.least(last - 1, F.floor(share * (CELLS - 2)) + 1))
    signed = F.when(v < 0, F.lit(1)).when(v == 0, F.lit(2)).otherwise(F.lit(3))
    return (
        F.when(F.isnan(v) | (v == inf), F.when(F.isnan(v), last).otherwise(last - 1))
        .when(v == -inf, F.lit(0))
        .when((lo <= 0) & (hi >= 0), signed)  # first by sign, so that what is left has one
        .when(F.isnan(hi) | (hi == inf) | (lo == -inf), F.lit(1))
        .when((large > 4 * small), step(of_log))
        .otherwise(step(linear))
        .cast("int")
    )


def _of_big(rows: DataFrame, big: DataFrame, n_big: int, names: list[str], quantiles: dict[str, float], sorted_rows: int) -> DataFrame:
    """Bounds of each big group and quantile, narrowed round by round; ``_rest`` is the rank among the values from _lo on.

    _after is the smallest value beyond _hi: the upper neighbour, where the rank turns out to be the last within bounds.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(q)).alias("_share")) for i, q in enumerate(quantiles.values())])).alias("x")
    start = big.select("*", each).select(*names, "_n", "x._q", "_lo", "_hi", F.floor((F.col("_n") - 1) * F.col("x._share")).alias("_rest"), F.col("_n").alias("_in"), F.lit(None).cast("double").alias("_after"))
    bounds = written_table(start, "quantile-bounds")
    n = n_big * len(quantiles)
    key = [*names, "_q"]
    while True:
        open_ = bounds.where((F.col("_in") > sorted_rows) & ~F.col("_lo").eqNullSafe(F.col("_hi")))
        if open_.isEmpty():
            break
        side = _hinted(open_.alias("o"), n)
        v = F.col("_v")
        inside = rows.where(v.isNotNull()).join(side, _same(rows, side, names) & (v >= F.col("_lo")) & (v <= F.col("_hi")))
        cells = inside.select(*[side[k] for k in names], "_q", "_v", _cell(v, F.col("_lo"), F.col("_hi")).alias("_cell"))
        counts = cells.groupBy(*key, "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        order = Window.partitionBy(*key).orderBy("_cell")  # CELLS rows at most
        counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_next": F.lead("_min").over(order)})
        counts = counts.select(*[F.col(k).alias(f"c{k}") for k in key], "_c", "_min", "_max", "_before", "_next")
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"c{k}"))
        hit = same & (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_c"))
        closer = open_.join(counts, hit).select(*key, "_n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("_c").alias("_in"), F.coalesce("_next", "_after").alias("_after"))
        done = bounds.where((F.col("_in") <= sorted_rows) | F.col("_lo").eqNullSafe(F.col("_hi")))
        bounds = written_table(done.unionByName(closer), "quantile-bounds")
    side = _hinted(bounds.alias("o"), n)
    v = F.col("_v")
    equal = F.col("_lo").eqNullSafe(F.col("_hi"))
    last = rows.where(v.isNotNull()).join(side, _same(rows, side, names) & ~equal & (v >= F.col("_lo")) & (v <= F.col("_hi")))
    last = last.select(*[side[k] for k in names], "_q", "_v", "_rest", "_in", "_after", "_n")
    ranked = last.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1)
    sorted_ = ranked.where((F.col("_r") == F.col("_rest")) | (F.col("_r") == F.col("_rest") + 1)).groupBy(*key, "_n").agg(
        F.max(F.when(F.col("_r") == F.col("_rest"), v)).alias("_a"), F.coalesce(F.max(F.when(F.col("_r") == F.col("_rest") + 1, v)), F.max("_after")).alias("_b")
    )
    alike = bounds.where(equal).select(*key, "_n", F.col("_lo").alias("_a"), F.when(F.col("_rest") + 1 < F.col("_in"), F.col("_lo")).otherwise(F.col("_after")).alias("_b"))
    pairs = sorted_.unionByName(alike)
    share = list(quantiles.items())
    picks = [F.max(F.when(F.col("_q") == i, _between(F.col("_a"), F.col("_b"), q, F.col("_n")))).alias(name) for i, (name, q) in enumerate(share)]
    return pairs.groupBy(*names).agg(*picks)
