"""Scalar functions on strings, numbers, dates, arrays, maps, structs and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import cosine
from tessera.plans.registry import register


@register(
    "str_fns",
    """select c_custkey, upper(c_name) as a, lower(c_mktsegment) as b, substring(c_name, 1, 4) as c, replace(c_name, '#', '-') as d,
       lpad(c_mktsegment, 12, '*') as e, reverse(c_name) as f, length(c_name)::int as g, instr(c_name, '#')::int as h,
       split_part(c_name, '#', 2) as i, trim(c_name) as j from customer""",
)
def str_fns(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    made = (F.upper(n), F.lower(m), F.substring(n, 1, 4), F.replace(n, F.lit("#"), F.lit("-")), F.lpad(m, 12, "*"), F.reverse(n), F.length(n), F.instr(n, "#"), F.split_part(n, F.lit("#"), F.lit(2)), F.trim(n))
    return t("customer").select("c_custkey", *[c.alias(k) for k, c in zip("abcdefghij", made, strict=True)])


@register("regex_fns", "select c_custkey, regexp_extract(c_name, '([0-9]+)', 1) as a, regexp_replace(c_name, '0', 'o', 'g') as b from customer")
def regex_fns(t):
    return t("customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("a"), F.regexp_replace("c_name", "0", "o").alias("b"))


@register(
    "date_fns",
    """select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, quarter(o_orderdate)::int as q, day(o_orderdate)::int as d,
       dayofyear(o_orderdate)::int as dy, last_day(o_orderdate) as ld, date_trunc('month', o_orderdate)::timestamp as dt,
       strftime(o_orderdate, '%Y-%m') as f from orders""",
)
def date_fns(t):
    d = F.col("o_orderdate")
    made = {"y": F.year(d), "m": F.month(d), "q": F.quarter(d), "d": F.dayofmonth(d), "dy": F.dayofyear(d), "ld": F.last_day(d), "dt": F.date_trunc("month", d).cast("timestamp_ntz"), "f": F.date_format(d, "yyyy-MM")}
    return t("orders").select("o_orderkey", *[c.alias(k) for k, c in made.items()])


@register(
    "math_fns",
    """select event_id, abs(-value) as a, ceil(value)::bigint as b, floor(value)::bigint as c, round(sqrt(value), 9) as d, round(ln(value), 9) as e,
       round(exp(value / 500), 9) as f, round(power(value, 2), 6) as g, sign(value)::double as h, round(log10(value), 9) as i, round(value, 1) as j,
       mod(event_id, 7)::bigint as k, greatest(value, 10) as l from events""",
)
def math_fns(t):
    v = F.col("value")
    # Spark's logarithm of 0 and below is null, SQL's is -inf and NaN.
    whole = lambda log: F.coalesce(log, F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))))
    made = (F.abs(-v), F.ceil(v), F.floor(v), F.round(F.sqrt(v), 9), F.round(whole(F.ln(v)), 9), F.round(F.exp(v / 500), 9), F.round(F.pow(v, F.lit(2)), 6), F.signum(v), F.round(whole(F.log10(v)), 9), F.round(v, 1), F.col("event_id") % 7, F.greatest(v, F.lit(10.0)))
    return t("events").select("event_id", *[c.alias(k) for k, c in zip("abcdefghijkl", made, strict=True)])


@register("arr_fns", "select vec_id, len(embedding)::int as n, embedding[1] as a, list_max(embedding) as b, embedding[1:3] as c from embeddings")
def arr_fns(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.size(e).alias("n"), e[0].alias("a"), F.array_max(e).alias("b"), F.slice(e, 1, 3).alias("c"))


@register("arr_hof", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 9) as n, len(list_filter(embedding, lambda x: x > 0))::int as p from embeddings")
def arr_hof(t):
    e = F.col("embedding")
    total = F.aggregate(F.transform(e, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.round(total, 9).alias("n"), F.size(F.filter(e, lambda x: x > 0)).alias("p"))


@register("explode_words", "select doc_id, unnest(string_split(text, ' ')) as w from documents")
def explode_words(t):
    return t("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))


@register("json_fns", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def json_fns(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("map_fns", "select event_id, map([event_type], [value])[event_type] as v, map_keys(map([event_type], [value])) as k from events")
def map_fns(t):
    m = F.create_map("event_type", "value")
    return t("events").select("event_id", m[F.col("event_type")].alias("v"), F.map_keys(m).alias("k"))


@register("struct_fns", "select event_id, struct_pack(a := user_id, b := value).a as a from events")
def struct_fns(t):
    return t("events").select("event_id", F.struct(F.col("user_id").alias("a"), F.col("value").alias("b"))["a"].alias("a"))


@register("hash_fns", "select doc_id, md5(text) as m, sha256(text) as s from documents")
def hash_fns(t):
    return t("documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@register(
    "cosine_to_first",
    """select b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]))
       / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x)) * list_sum(list_transform(b.embedding, lambda x: x::double * x))), 9) as s
       from embeddings b, (select embedding from embeddings where vec_id = 0) a""",
)
def cosine_to_first(t):
    """Every vector against one: the one is a row, so its broadcast is bounded."""
    one = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return t("embeddings").join(F.broadcast(one)).select("vec_id", F.round(cosine("q", "embedding"), 9).alias("s"))
