"""Recursion over links that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import closure, top_per_group
from tessera.plans.registry import register


def favourites(t):
    """src, dst: each customer's supplier of most line items, and each supplier's customer of most; of equals the smallest key.

    Nodes are c and s with the key. Counts are whole numbers, so both engines see the same ties.
    """
    bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k, other: top_per_group(bought, [k], [F.desc("n"), F.asc(other)], 1)
    node = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
    forward = of("o_custkey", "l_suppkey").select(node("c", "o_custkey").alias("src"), node("s", "l_suppkey").alias("dst"))
    return forward.unionByName(of("l_suppkey", "o_custkey").select(node("s", "l_suppkey").alias("src"), node("c", "o_custkey").alias("dst")))


@register(
    "cte_recursive",
    """with recursive bought as (select o_custkey as c, l_suppkey as s, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
       links as (select 'c' || c as src, 's' || s as dst from (select c, s, row_number() over (partition by c order by n desc, s) as k from bought) where k = 1
                 union all select 's' || s, 'c' || c from (select c, s, row_number() over (partition by s order by n desc, c) as k from bought) where k = 1),
       reached as (select src, dst from links union select r.src, l.dst from reached r join links l on r.dst = l.src)
       select src, dst from reached""",
)
def cte_recursive(t):
    return closure(favourites(t)).select("src", "dst")
