"""Aggregates, grouping sets and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import exact_quantiles
from tessera.plans.registry import register


@register("agg_group", "select l_returnflag, l_linestatus, sum(l_quantity) as q, avg(l_discount) as d, min(l_tax) as mn, max(l_tax) as mx, count(*) as n from lineitem group by 1, 2")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.min("l_tax").alias("mn"), F.max("l_tax").alias("mx"), F.count(F.lit(1)).alias("n"))


@register("agg_having", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 15")
def agg_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@register("agg_distinct", "select o_orderpriority, count(distinct o_custkey) as n from orders group by 1")
def agg_distinct(t):
    return t("orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@register("agg_filter", "select event_type, count(*) filter (where value > 100) as n from events group by 1")
def agg_filter(t):
    return t("events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("n"))


def _by_flag(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


@register("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return _by_flag(t("lineitem").rollup("l_returnflag", "l_linestatus"))


@register("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def agg_cube(t):
    return _by_flag(t("lineitem").cube("l_returnflag", "l_linestatus"))


@register("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(t):
    df = t("lineitem")
    return _by_flag(df.groupingSets([[df["l_returnflag"]], [df["l_linestatus"]], []], df["l_returnflag"], df["l_linestatus"]))


@register("agg_stats", "select event_type, round(stddev(value), 6) as a, round(var_pop(value), 6) as b, round(corr(value, user_id), 6) as c, round(covar_samp(value, user_id), 6) as d from events group by 1")
def agg_stats(t):
    r = lambda c, name: F.round(c, 6).alias(name)
    return t("events").groupBy("event_type").agg(r(F.stddev("value"), "a"), r(F.var_pop("value"), "b"), r(F.corr("value", "user_id"), "c"), r(F.covar_samp("value", "user_id"), "d"))


@register("agg_median", "select event_type, median(value) as m, quantile_cont(value, 0.9) as p from events group by 1")
def agg_median(t):
    return exact_quantiles(t("events"), ["event_type"], "value", {"m": 0.5, "p": 0.9})


@register("agg_argmax", "select user_id, arg_max(event_id, ts) as e from events group by 1")
def agg_argmax(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("e"))


@register("agg_collect", "select user_id, list_sort(list(event_id)) as l from events group by 1")
def agg_collect(t):
    return t("events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("l"))


@register("agg_bool", "select user_id, bool_or(value > 400) as a, bool_and(value > 1) as b from events group by 1")
def agg_bool(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("value") > 400).alias("a"), F.bool_and(F.col("value") > 1).alias("b"))


@register("agg_approx_distinct")
def agg_approx_distinct(t):
    """The two engines' sketches differ, so there is no SQL for it; tests hold it against the exact count."""
    return t("orders").agg(F.approx_count_distinct("o_custkey").alias("n"))


@register("agg_listagg", "select n_regionkey, string_agg(n_name, ',' order by n_name) as s from nation group by 1")
def agg_listagg(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("s"))


@register("pivot", "select user_id, count(value) filter (event_type = 'click') as click, count(value) filter (event_type = 'view') as view from events group by 1")
def pivot(t):
    return t("events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count("value")).na.fill(0, ["click", "view"])


@register("dedup_exact", "select min(doc_id) as doc_id, count(*) as n from documents group by md5(text)")
def dedup_exact(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@register("label_join_rate", "select lang, avg(quality) as q, count(*) as n from documents join labels using (doc_id) group by lang")
def label_join_rate(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.count(F.lit(1)).alias("n"))
