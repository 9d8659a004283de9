"""Formats other than parquet, rows that can't be parsed, and plans over bucketed and partitioned tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.sources.formats import CORRUPT, OPTIONS, bucketed, difference, parsed_or_kept, partitioned, stored

DATA = "/root/testdata/sf0.001"
ODD = [(1, "plain", 1.5, True, dt.date(2024, 2, 29)), (2, None, None, None, None), (3, "", -0.0, False, dt.date(1970, 1, 1)), (4, 'a "quoted", text\nof two\tlines', 1e300, True, None), (5, "null", 0.1, None, None), (6, "<x>&amp;é中</x>", 3.0, True, None), (1, "plain", 1.5, True, dt.date(2024, 2, 29))]


@pytest.mark.parametrize("kind", sorted(OPTIONS))
def test_formats_give_back_every_row(spark, kind):
    table = spark.createDataFrame(ODD, "id long, text string, x double, flag boolean, day date").repartition(2)
    assert tuple(difference(table, stored(table, kind)).first()) == (len(ODD), 0, 0)


def test_nested_columns_through_json_and_orc(spark):
    table = spark.createDataFrame([(1, [1, None], {"a": 1}, (2, None)), (2, [], {}, None), (3, None, None, (None, "z"))], "id long, l array<long>, m map<string, int>, s struct<p: int, q: string>")
    for kind in ("json", "orc", "parquet"):
        assert sorted(map(repr, stored(table, kind).collect())) == sorted(map(repr, table.collect()))


def test_difference_counts_copies_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (1, ""), (2, "x"), (2, "x")], "k int, v string")
    assert tuple(difference(a, b).first()) == (3, 1, 2) and tuple(difference(a.limit(0), a.limit(0)).first()) == (0, 0, 0)


def test_bad_rows_are_kept_whole(spark):
    lines = ['{"k": 1, "t": "a"}', '{"k": "x"}', "not json", '{"k": 3', "{}", '{"t": null, "k": 4}']
    got = parsed_or_kept(spark.createDataFrame([(x,) for x in lines], "value string"), StructType([StructField("k", LongType()), StructField("t", StringType())])).collect()
    assert sorted((r["k"], r[CORRUPT]) for r in got if r["k"] is not None) == [(1, None), (4, None)]
    assert {r[CORRUPT] for r in got if r[CORRUPT]} == {'{"k": "x"}', "not json", '{"k": 3'} and len(got) == len(lines)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark):
    orders = bucketed(spark.read.parquet(f"{DATA}/orders.parquet").withColumnRenamed("o_orderkey", "k"), "k", 4, "o")
    lines = bucketed(spark.read.parquet(f"{DATA}/lineitem.parquet").withColumnRenamed("l_orderkey", "k"), "k", 4, "l")
    joined = orders.hint("merge").join(lines, "k")
    assert "Exchange" not in physical(joined) and "SortMergeJoin" in physical(joined)
    assert joined.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert "Exchange" not in physical(lines.groupBy("k").count())
    assert len(lines.inputFiles()) == 4
    assert lines.where("k = 7").count() == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey = 7").count()


def test_partition_filters_read_their_folders_only(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    clicks = partitioned(events, ["event_type"]).where("event_type = 'click' and value > 1")
    plan = physical(clicks)
    assert "PartitionFilters: [isnotnull(event_type" in plan and "PushedFilters: [IsNotNull(value), GreaterThan(value,1.0)]" in plan
    files = clicks.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("event_type=click" in r["f"] for r in files)
    assert clicks.count() == events.where("event_type = 'click' and value > 1").count()
