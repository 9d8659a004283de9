"""Scans, projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register


@register("scan_count", "select count(*) as n from lineitem")
def scan_count(t):
    return t("lineitem").agg(F.count(F.lit(1)).alias("n"))


@register("project_expr", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as rev from lineitem")
def project_expr(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))


@register("filter_cmp", "select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
def filter_cmp(t):
    return t("orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@register("filter_between_in_like", "select p_partkey from part where p_size between 5 and 20 and p_brand in ('Brand#1', 'Brand#9') and p_name like '%anvil%'")
def filter_between_in_like(t):
    return t("part").where(F.col("p_size").between(5, 20) & F.col("p_brand").isin("Brand#1", "Brand#9") & F.col("p_name").like("%anvil%")).select("p_partkey")


@register("filter_rlike", "select p_partkey from part where regexp_matches(p_name, '^blue.*t$')")
def filter_rlike(t):
    return t("part").where(F.col("p_name").rlike("^blue.*t$")).select("p_partkey")


@register("case_coalesce_nullif", "select o_orderkey, case when o_totalprice > 200000 then 'hi' else 'lo' end as b, coalesce(nullif(o_orderstatus, 'F'), 'x') as c from orders")
def case_coalesce_nullif(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "hi").otherwise("lo").alias("b"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("x")).alias("c"))


@register("select_distinct", "select distinct c_mktsegment from customer")
def select_distinct(t):
    return t("customer").select("c_mktsegment").distinct()


@register("sort_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def sort_topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 20")
def limit_offset(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(10)


@register("union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
def union_all(t):
    return t("nation").select(F.col("n_regionkey").alias("k")).unionAll(t("region").select("r_regionkey"))


@register("union_distinct", "select n_regionkey as k from nation union select r_regionkey from region")
def union_distinct(t):
    return t("nation").select(F.col("n_regionkey").alias("k")).unionAll(t("region").select("r_regionkey")).distinct()


@register("intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@register("intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@register("except_distinct", "select o_orderkey as k from orders except select l_orderkey from lineitem")
def except_distinct(t):
    return t("orders").select(F.col("o_orderkey").alias("k")).subtract(t("lineitem").select("l_orderkey"))


@register("except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@register("unpivot", "select * from (select l_orderkey, l_linenumber, l_quantity, l_tax from lineitem) unpivot (v for k in (l_quantity, l_tax))")
def unpivot(t):
    return t("lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "k", "v")
