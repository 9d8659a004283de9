"""Event-time windows in batch; tessera.streaming has the same over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.plans.registry import register


@register("time_tumbling", "select time_bucket(interval '1 hour', ts) as w, count(*) as n, round(sum(value), 6) as v from events group by 1")
def time_tumbling(t):
    w = F.window("ts", "1 hour")
    return t("events").groupBy(w.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("v")).select(F.col("x.start").alias("w"), "n", "v")


@register("time_sliding", "select w, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval 30 minute]) as w from events) group by 1")
def time_sliding(t):
    return t("events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("x")).agg(F.count(F.lit(1)).alias("n")).select(F.col("x.start").alias("w"), "n")


@register(
    "time_session",
    """with a as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as f from events window w as (partition by user_id order by ts)),
       b as (select *, sum(f) over (partition by user_id order by ts) as g from a) select user_id, min(ts) as start, count(*) as n from b group by user_id, g""",
)
def time_session(t):
    return sessions(t("events"), ["user_id"], "ts", "6 hours")
