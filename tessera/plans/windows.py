"""Window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import top_per_group
from tessera.plans.registry import register


def by_user():
    return Window.partitionBy("user_id").orderBy("ts")


def whole():
    return by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


@register(
    "win_rank",
    """select event_id, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, percent_rank() over w as pr,
       cume_dist() over w as cd, ntile(4) over w as nt from events window w as (partition by user_id order by ts)""",
)
def win_rank(t):
    ranks = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "pr": F.percent_rank(), "cd": F.cume_dist(), "nt": F.ntile(4)}
    long = ("rn", "rk", "dr", "nt")
    return t("events").select("event_id", *[(f.over(by_user()).cast("bigint") if k in long else f.over(by_user())).alias(k) for k, f in ranks.items()])


@register("win_lag_lead", "select event_id, lag(value, 1) over w as a, lead(value, 2) over w as b from events window w as (partition by user_id order by ts)")
def win_lag_lead(t):
    return t("events").select("event_id", F.lag("value", 1).over(by_user()).alias("a"), F.lead("value", 2).over(by_user()).alias("b"))


@register(
    "win_first_last_nth",
    """select event_id, first_value(value) over w as a, last_value(value) over w as b, nth_value(value, 2) over w as c
       from events window w as (partition by user_id order by ts rows between unbounded preceding and unbounded following)""",
)
def win_first_last_nth(t):
    return t("events").select("event_id", F.first_value("value").over(whole()).alias("a"), F.last_value("value").over(whole()).alias("b"), F.nth_value("value", 2).over(whole()).alias("c"))


@register("win_rows", "select event_id, round(sum(value) over (partition by user_id order by ts rows between 2 preceding and current row), 6) as v from events")
def win_rows(t):
    return t("events").select("event_id", F.round(F.sum("value").over(by_user().rowsBetween(-2, 0)), 6).alias("v"))


@register("win_range_interval", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as v from events")
def win_range_interval(t):
    return t("events").select("event_id", F.expr("count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row)").alias("v"))


@register("win_qualify", "select event_id, user_id, rn from (select event_id, user_id, row_number() over (partition by user_id order by ts desc) as rn from events) where rn <= 3")
def win_qualify(t):
    found = top_per_group(t("events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts")], 3)
    return found.select("event_id", "user_id", F.col("rn").cast("bigint").alias("rn"))
