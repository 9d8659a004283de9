"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@register(
    "q1_like",
    """select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as charge
       from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
def q1_like(t):
    before = F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'")
    return t("lineitem").where(before).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 2).alias("charge"))


@register(
    "q3_like",
    """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as rev, o_orderdate from customer join orders on c_custkey = o_custkey
       join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey, o_orderdate order by rev desc, l_orderkey limit 10""",
)
def q3_like(t):
    building = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = t("orders").join(building, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderdate")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 4).alias("rev")).orderBy(F.desc("rev"), "l_orderkey").limit(10)


@register(
    "q5_like",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as rev from customer join orders on c_custkey = o_custkey
       join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
       join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name""",
)
def q5_like(t):
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = t("supplier").join(asia, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return lines.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("rev"))
