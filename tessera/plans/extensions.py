"""Sketches, functions of one's own over Arrow, table functions and variant values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrow, sketches
from tessera.plans.registry import register


@register(
    "sketch_months",
    """select date_trunc('month', o_orderdate)::timestamp as month, count(distinct o_custkey) as customers, true as customers_within, true as median_within from orders group by 1""",
)
def sketch_months(t):
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    orders = t("orders").withColumn("month", month("o_orderdate"))
    days = sketches.sketched(orders, ["month", "o_orderdate"], "o_custkey", "o_totalprice")
    months = sketches.merged(days, ["month"]).select("month", sketches.distinct_estimate("keys").alias("estimate"), sketches.quantile_estimate("values", 0.5).alias("median"))
    price = F.col("o_totalprice")
    exact = orders.join(months, "month").groupBy("month", "estimate").agg(
        F.countDistinct("o_custkey").alias("customers"), F.count_if(price < F.col("median")).alias("below"), F.count_if(price <= F.col("median")).alias("upto"), F.count("o_totalprice").alias("n")
    )
    return exact.select(
        "month", "customers", sketches.distinct_within(F.col("estimate"), F.col("customers")).alias("customers_within"), sketches.rank_within(F.col("below"), F.col("upto"), F.col("n"), 0.5).alias("median_within")
    )


@register("udaf_geometric_mean", "select l_returnflag, l_linestatus, round(exp(sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity)), 4) as price from lineitem where l_extendedprice > 0 group by all")
def udaf_geometric_mean(t):
    found = arrow.weighted_geometric_mean(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", "price")
    return found.select("l_returnflag", "l_linestatus", F.round("price", 4).alias("price"))


@register(
    "udaf_trailing_mean",
    """select event_id, round(exp(sum((1 + event_id % 3) * ln(value)) over w / sum(1 + event_id % 3) over w), 6) as mean from events where value > 0
       window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""",
)
def udaf_trailing_mean(t):
    events = t("events").where("value > 0").withColumn("weight", 1 + F.col("event_id") % 3)
    return arrow.trailing_geometric_mean(events, ["user_id"], ["ts", "event_id"], "value", "weight", "mean", 4).select("event_id", F.round("mean", 6).alias("mean"))


@register(
    "udtf_runs",
    """with a as (select *, case when event_type is not distinct from lag(event_type) over u then 0 else 1 end as f from events window u as (partition by user_id order by ts, event_id)),
       b as (select *, sum(f) over (partition by user_id order by ts, event_id) as g from a)
       select user_id, event_type, min_by(event_id, (ts, event_id)) as first_id, max_by(event_id, (ts, event_id)) as last_id, count(*) as n from b group by user_id, event_type, g""",
)
def udtf_runs(t):
    found = arrow.runs(t("events"), "user_id", ["ts", "event_id"], "event_type", "event_id")
    return found.select(F.col("key").alias("user_id"), F.col("kind").alias("event_type"), "first_id", "last_id", "n")


#: The props of events as values of several types: by event_id, as they are, k as text, as a list, and cut short.
_MIXED = """case event_id % 4 when 0 then props when 1 then regexp_replace(props, '([0-9]+)', '"{one}"') when 2 then regexp_replace(props, '([0-9]+)', '[{one}, null]') else substring(props, 1, 5) end"""


@register(
    "variant_paths",
    f"""with a as (select event_id, {_MIXED.format(one=chr(92) + "1")} as j from events),
       b as (select event_id, case when json_valid(j) then j::json end as j from a)
       select event_id, coalesce(try_cast(json_extract_string(j, '$.k') as bigint), json_extract_string(j, '$.k[0]')::bigint) as k, j is not null as ok,
       json_type(j, '$.k') = 'ARRAY' as listed, json_array_length(j, '$.k')::integer as length from b""",
)
def variant_paths(t):
    v = t("events").select("event_id", F.try_parse_json(F.expr(_MIXED.format(one="$1"))).alias("v"))
    k = F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$.k[0]", "bigint"))
    items = F.try_variant_get("v", "$.k", "array<variant>")
    listed = F.schema_of_variant(F.variant_get("v", "$.k", "variant")).startswith("ARRAY")
    return v.select("event_id", k.alias("k"), F.col("v").isNotNull().alias("ok"), listed.alias("listed"), F.when(listed, F.size(items)).when(F.col("v").isNotNull(), 0).alias("length"))


@register("variant_schema", "select event_type, 'OBJECT<k: BIGINT>' as shape, count(*) as n from events where json_type(props, '$.k') in ('UBIGINT', 'BIGINT') group by event_type")
def variant_schema(t):
    return t("events").groupBy("event_type").agg(F.schema_of_variant_agg(F.try_parse_json("props")).alias("shape"), F.count(F.lit(1)).alias("n"))
