"""Every core query against its DuckDB SQL, and the composed operators on small rows."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import cosine
from tessera.operators import asof_join, closure, exact_quantiles, not_in, range_join, top_per_group
from tessera.sources import TABLES, written_table

DATA = "/root/testdata/sf0.001"


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, same(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(same, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(same, r)) for r in zip(*[table[c].to_pylist() for c in names], strict=True)), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, DATA).toArrow()) == rows(duck.sql(plans.oracle_sql()[name]).to_arrow_table())


def test_logarithms_of_zero_and_below_are_those_of_sql(spark, tmp_path):
    values = [0.0, 0.0, -1.5, 2.5, None, 1.0]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.queries()["math_fns"](spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got) == rows(con.sql(plans.oracle_sql()["math_fns"]).to_arrow_table())
    logs = {r["event_id"]: (r["e"], r["i"]) for r in got.select(["event_id", "e", "i"]).to_pylist()}
    assert logs[0] == logs[1] == (-math.inf, -math.inf) and all(map(math.isnan, logs[2])) and logs[4] == (None, None)


def test_approximate_distinct_is_close(spark):
    exact = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey").distinct().count()
    assert abs(plans.queries()["agg_approx_distinct"](spark, DATA).first()["n"] - exact) <= 0.15 * exact


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def test_asof_join_takes_the_last_not_later(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, "b", at(9)), (4, None, at(5)), (5, "a", None)], "id long, k string, t timestamp")
    right = spark.createDataFrame([("a", at(2), 10), ("a", at(5), 20), ("a", at(5), 21), ("a", at(6), 30), (None, at(1), 40), ("a", None, 50)], "k string, t timestamp, v int")
    got = {r["id"]: r["x"] for r in asof_join(left, right, ["k"], "t", {"x": "v"}).collect()}
    assert got == {1: 21, 2: None, 3: None, 4: None, 5: None}


def test_range_join_pairs_once(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, None), (5, -3.0)], "p long, x double")
    ranges = spark.createDataFrame([(1, -5.0, 30.0), (2, 10.0, 10.0), (3, 5.0, 1.0), (4, None, 2.0)], "r long, lo double, hi double")
    got = sorted((r["p"], r["r"]) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2), (5, 1)]


def test_range_join_has_no_nested_loop(spark):
    points, ranges = spark.range(10).select(F.col("id").cast("double").alias("x")), spark.range(10).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 1).cast("double").alias("hi"))
    plan = range_join(points, ranges, "x", "lo", "hi", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("others, left", [([2], [1, 3]), ([2, 2, 9], [1, 3]), ([2, None], []), ([None], []), ([], [1, 2, 3, None])])
def test_not_in_follows_the_rules_for_nulls(spark, others, left):
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    found = not_in(rows, "k", spark.createDataFrame([(x,) for x in others], "o int"), "o")
    assert sorted((r["k"] for r in found.collect()), key=lambda k: (k is None, k)) == left


def test_not_in_broadcasts_its_counts_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plans.queries()["subq_not_in"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("BroadcastExchange") == 1


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "g string, v int")
    assert sorted((r["g"], r["v"]) for r in top_per_group(df, ["g"], [F.desc("v")], 2).collect()) == [("a", 2), ("a", 3), ("b", 9)]


def test_cosine_of_no_length_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(cosine("a", "b").alias("c")).collect()] == [1.0, None]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.queries()["filter_cmp"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_orderdate" not in plan


def plain_asof(left, right):
    out = {}
    for i, k, t in left:
        before = [(u, v) for key, u, v in right if key == k and None not in (k, t, u) and u <= t]
        out[i] = max(before)[1] if before else None
    return out


@pytest.mark.parametrize("hot_rows", [0, 40, 1 << 20])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "int"])
def test_asof_join_of_split_keys_equals_a_plain_loop(spark, monkeypatch, hot_rows, kind):
    monkeypatch.setattr("tessera.operators.joins.RANGES", 16)
    rng = random.Random(7)
    when = (lambda: rng.randrange(50)) if kind == "int" else (lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice([rng.randrange(400), 77])))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), None if i % 17 == 0 else when()) for i in range(300)]
    right = [(key(), None if i % 19 == 0 else when(), i) for i in range(120)]
    right = [r for r in right if r[0] != "hot" or r[1] is None or rng.random() < 0.5]  # ranges without a right row
    got = asof_join(spark.createDataFrame(left, f"id long, k string, t {kind}"), spark.createDataFrame(right, f"k string, t {kind}, v int"), ["k"], "t", {"x": "v"}, hot_rows=hot_rows)
    assert got.columns == ["id", "k", "t", "x"] and {r["id"]: r["x"] for r in got.collect()} == plain_asof(left, right)


def test_asof_join_deals_one_key_to_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        times = spark.range(40_000).select(F.lit("only").alias("k"), F.col("id").alias("t"), (F.col("id") * 3).alias("v"))
        out = asof_join(times.drop("v"), times.where("t % 5 = 0"), ["k"], "t", {"x": "v"}, hot_rows=1000)
        assert out.where("x != (t - t % 5) * 3 or x is null").count() == 0
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.3 * 40_000 / 4


def walks(links):
    """(src, dst): hops by breadth-first search."""
    out, next_of = {}, {}
    for a, b in links:
        next_of.setdefault(a, set()).add(b)
    for start in next_of:
        edge, hops, seen = {start}, 0, {}
        while edge:
            hops += 1
            edge = {b for a in edge for b in next_of.get(a, ())} - set(seen)
            seen |= dict.fromkeys(edge, hops)
        out |= {(start, b): h for b, h in seen.items()}
    return out


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(37)], [(i, (i + 1) % 12) for i in range(12)], [(1, 2), (1, 2), (2, 3), (1, 3), (3, 3), (9, 1)], []])
def test_closure_equals_breadth_first_search(spark, links):
    table = spark.createDataFrame([*links, (None, 1), (1, None)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["hops"] for r in closure(table).collect()} == walks(links)


def test_closure_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    assert {(r["src"], r["dst"]): r["hops"] for r in closure(spark.createDataFrame(links, "src long, dst long")).collect()} == walks(links)


def test_closure_gives_no_part_of_an_answer(spark):
    with pytest.raises(ValueError):
        closure(spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long"), rounds=3)


def test_shared_folder_is_the_named_one(spark):
    assert written_table(spark.range(3), "three").inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(spark.conf.get("spark.checkpoint.dir"))


def plain_quantile(values, q):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    place = (len(v) - 1) * q
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if math.floor(place) == place else (math.ceil(place) - place) * a + (place - math.floor(place)) * b


@pytest.mark.parametrize("sorted_rows", [1, 20, 1 << 16])
def test_exact_quantiles_equal_a_sort(spark, sorted_rows):
    rng, inf = random.Random(5), math.inf
    groups = {
        "even": [float(i) for i in range(300)],
        "ties": [1.0] * 90 + [2.0] * 90 + [3.0],
        "wide": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(200)],
        "below": [-(10.0 ** rng.uniform(-20, 20)) for _ in range(101)],
        "signs": [rng.gauss(0, 1e-3) for _ in range(120)] + [0.0] * 31 + [1e300, -1e300, None],
        "odd": [inf] * 40 + [-inf] * 30 + [math.nan] * 35 + [rng.random() for _ in range(60)],
        "steps": [rng.choice([0.1, 0.2, 0.30000000000000004, 0.3]) for _ in range(150)],
        "none": [None, None],
        "one": [4.5],
        None: [float(i % 7) for i in range(64)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", wanted, sorted_rows=sorted_rows).collect()
    assert {r["g"]: tuple(repr(r[k]) for k in wanted) for r in got} == {g: tuple(repr(plain_quantile(values, q)) for q in wanted.values()) for g, values in groups.items()}


def test_exact_quantiles_sort_few_rows_of_a_group(spark):
    table = spark.range(60_000).select(F.lit("one").alias("g"), (F.hash("id") % 1000003).cast("double").alias("v"))
    out = exact_quantiles(table, ["g"], "v", {"m": 0.5, "p": 0.99}, sorted_rows=500)
    v = sorted(r["v"] for r in table.collect())
    assert out.first()[1:] == (plain_quantile(v, 0.5), plain_quantile(v, 0.99))
    plan = plans.queries()["agg_median"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_exact_quantiles_of_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5}).collect() == []
