"""Formats, buckets and partitions: what is read back is what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.plans.registry import register
from tessera.sources.formats import CORRUPT, OPTIONS, bucketed, difference, parsed_or_kept, partitioned, stored

#: Customers with nulls, empty texts, quotes, separators and line ends among their names.
_NAMES = "case c_custkey % 4 when 0 then null when 1 then '' when 2 then replace(c_name, '#', '\", ''\n') else c_name end"


@register("source_round_trips", "select format, count(*) as rows, 0 as lost, 0 as added from customer, (values ('csv'), ('json'), ('orc'), ('parquet'), ('xml')) f(format) group by format")
def source_round_trips(t):
    customers = t("customer").withColumns({"c_name": F.expr(_NAMES), "c_acctbal": F.expr("nullif(c_acctbal, 0)")})
    found = [difference(customers, stored(customers, kind)).select(F.lit(kind).alias("format"), "rows", F.col("lost").cast("int"), F.col("added").cast("int")) for kind in sorted(OPTIONS)]
    return reduce(DataFrame.unionByName, found)


@register(
    "source_bad_rows",
    """select case when event_id % 10 = 3 then null else json_extract(props, '$.k')::bigint end as k, event_id % 10 = 3 as bad, count(*) as n from events group by all""",
)
def source_bad_rows(t):
    lines = t("events").select(F.expr("if(event_id % 10 = 3, left(props, length(props) - 2), props)").alias("value"))
    rows = parsed_or_kept(lines, StructType([StructField("k", LongType())]))
    return rows.groupBy("k", F.col(CORRUPT).isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@register("sink_bucketed_join", "select o_orderpriority, count(*) as n, sum(l_linenumber)::bigint as lines from orders join lineitem on o_orderkey = l_orderkey group by 1")
def sink_bucketed_join(t):
    orders = bucketed(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 16, "orders")
    lines = bucketed(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey", 16, "lineitem")
    return orders.hint("merge").join(lines, "o_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@register("sink_partitioned", "select event_type, user_id, count(*) as n from events where event_type in ('click', 'purchase') group by all")
def sink_partitioned(t):
    kinds = partitioned(t("events"), ["event_type"])
    return kinds.where(F.col("event_type").isin("click", "purchase")).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
