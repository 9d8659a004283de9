"""Sketches, Arrow aggregates, table functions and variants on small rows; their queries are held against SQL in test_core."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import arrow, sketches

DATA = "/root/testdata/sf0.001"


def test_merged_sketches_are_those_of_all_rows(spark):
    table = spark.range(30_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7 % 9_001).alias("k"), F.sqrt("id").alias("v"))
    days = sketches.sketched(table, ["day"], "k", "v")
    row = sketches.merged(days, []).select(sketches.distinct_estimate("keys").alias("n"), sketches.quantile_estimate("values", 0.25).alias("q")).first()
    assert abs(row["n"] - 9_001) <= 4 * sketches.DISTINCT_ERROR * 9_001
    assert abs(table.where(F.col("v") <= row["q"]).count() / 30_000 - 0.25) <= 2 * sketches.RANK_ERROR


def test_sketch_bounds_can_fail(spark):
    wrong = spark.range(1).select(sketches.distinct_within(F.lit(1200), F.lit(1000)).alias("d"), sketches.rank_within(F.lit(700), F.lit(700), F.lit(1000), 0.5).alias("r")).first()
    assert not wrong["d"] and not wrong["r"]


def test_sketches_of_nulls_and_of_no_rows(spark):
    table = spark.createDataFrame([("a", None, None), ("b", 3, 1.5), ("b", 3, None)], "g string, k long, v double")
    got = {r["g"]: r["n"] for r in sketches.sketched(table, ["g"], "k", "v").select("g", sketches.distinct_estimate("keys").alias("n")).collect()}
    assert got == {"a": 0, "b": 1}
    assert sketches.sketched(table.limit(0), ["g"], "k", "v").count() == 0


ODD = [("a", 2.0, 1.0), ("a", 8.0, 1.0), ("b", 3.0, 0.0), ("c", None, 1.0), ("c", 5.0, None), ("c", -4.0, 2.0), ("c", 0.0, 2.0), ("d", 7.0, 2.5), (None, 9.0, 1.0), ("e", 2.0, -1.0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_weighted_geometric_mean_of_odd_groups(spark, parts):
    table = spark.createDataFrame(ODD, "g string, x double, w double")
    got = {r["g"]: r["m"] and round(r["m"], 9) for r in arrow.weighted_geometric_mean(table, ["g"], "x", "w", "m", parts).collect()}
    assert got == {"a": 4.0, "b": None, "c": None, "d": 7.0, None: 9.0, "e": None}
    assert arrow.weighted_geometric_mean(table.limit(0), ["g"], "x", "w", "m").count() == 0


def test_weighted_geometric_mean_deals_a_hot_group_out(spark):
    table = spark.range(8_000).select(F.lit("hot").alias("g"), (F.col("id") + 1).cast("double").alias("x"), F.lit(1.0).alias("w"))
    out = arrow.weighted_geometric_mean(table, ["g"], "x", "w", "m", parts=16)
    assert math.isclose(out.first()["m"], math.exp(sum(math.log(i + 1) for i in range(8_000)) / 8_000), rel_tol=1e-9)
    salted = table.select(F.pmod(F.xxhash64("x", "w", F.spark_partition_id()), F.lit(16)).alias("p")).groupBy("p").count().agg(F.count("*"), F.max("count")).first()
    assert salted[0] == 16 and salted[1] < 2 * 8_000 / 16


def test_trailing_mean_of_odd_frames(spark):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ODD)], "id long, g string, x double, w double")
    got = {r["id"]: r["m"] and round(r["m"], 9) for r in arrow.trailing_geometric_mean(table, ["g"], ["id"], "x", "w", "m", 1).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 7.0, 8: 9.0, 9: None}


def test_runs_of_nulls_ties_and_no_rows(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "a"), (None, 1, "b"), (None, 2, "b")]
    table = spark.createDataFrame([(u, t, k, 10 * t, "x") for u, t, k in rows], "u long, t long, k string, id long, last_id string")
    got = sorted((tuple(r) for r in arrow.runs(table, "u", ["t"], "k", "id").collect()), key=repr)
    assert got == sorted([(1, "a", 10, 20, 2), (1, None, 30, 40, 2), (1, "a", 50, 50, 1), (2, "a", 10, 10, 1), (None, "b", 10, 20, 2)], key=repr)
    assert arrow.runs(table.limit(0), "u", ["t"], "k", "id").count() == 0


def test_variant_query_has_every_kind(spark):
    rows = plans.queries()["variant_paths"](spark, DATA).collect()
    assert {(r["ok"], r["listed"]) for r in rows} == {(True, False), (True, True), (False, None)} and all(r["k"] is not None for r in rows if r["ok"])
