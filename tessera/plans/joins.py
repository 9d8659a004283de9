"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import asof_join, not_in, range_join
from tessera.plans.registry import register


@register("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@register("join_left", "select o_orderkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 49")
def join_left(t):
    return t("orders").join(t("lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


@register("join_right", "select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey and o_totalprice > 400000")
def join_right(t):
    return t("orders").where("o_totalprice > 400000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@register("join_full", "select d.doc_id as a, l.doc_id as q from documents d full join labels l on d.doc_id = l.doc_id")
def join_full(t):
    labels = t("labels").select(F.col("doc_id").alias("q"))
    return t("documents").select(F.col("doc_id").alias("a")).join(labels, F.col("a") == F.col("q"), "full")


@register("join_semi", "select o_orderkey from orders semi join lineitem on o_orderkey = l_orderkey")
def join_semi(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@register("join_anti", "select o_orderkey from orders anti join lineitem on o_orderkey = l_orderkey")
def join_anti(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register("join_cross", "select r_name, n_name from region cross join nation")
def join_cross(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@register("join_theta_range", "select s.s_suppkey as a, c.c_custkey as b from supplier s join customer c on c.c_acctbal between s.s_acctbal - 5 and s.s_acctbal + 5")
def join_theta_range(t):
    ranges = t("supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return range_join(t("customer"), ranges, "c_acctbal", "low", "high", 10.0).select(F.col("s_suppkey").alias("a"), F.col("c_custkey").alias("b"))


@register("join_interval", "select a.event_id as x, b.event_id as y from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
def join_interval(t):
    # An hour after an event ends in its own or the next hour, so equality of user and hour replaces pairs of a user.
    hour = F.expr("cast(unix_seconds(cast(ts as timestamp)) div 3600 as bigint)")
    a = t("events").select(F.col("event_id").alias("x"), F.col("user_id").alias("u"), F.col("ts").alias("ta"), F.explode(F.array(hour, hour + 1)).alias("h"))
    b = t("events").select(F.col("event_id").alias("y"), F.col("user_id").alias("u"), F.col("ts").alias("tb"), hour.alias("h"))
    return a.join(b, ["u", "h"]).where(F.expr("tb > ta and tb <= ta + interval 1 hour")).select("x", "y")


@register(
    "join_asof",
    """select a.event_id as event_id, b.event_id as pid from (select * from events where event_type = 'purchase') a
       asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.ts >= b.ts""",
)
def join_asof(t):
    left, right = t("events").where("event_type = 'purchase'"), t("events").where("event_type = 'click'")
    return asof_join(left.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", {"pid": "event_id"}).select("event_id", "pid")


@register("subq_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def subq_exists(t):
    return t("customer").join(t("orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@register("subq_not_in", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def subq_not_in(t):
    return not_in(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").select("o_orderkey")


@register("subq_scalar_corr", "select p_partkey from part p where p_retailprice > (select avg(p_retailprice) from part q where q.p_brand = p.p_brand)")
def subq_scalar_corr(t):
    mean = t("part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    return t("part").join(mean, "p_brand").where("p_retailprice > mean").select("p_partkey")


@register("lateral", "select c_custkey, k from customer, lateral (select max(o_orderkey) as k from orders where o_custkey = c_custkey)")
def lateral(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k"))
    return t("customer").join(last, "c_custkey", "left").select("c_custkey", "k")
