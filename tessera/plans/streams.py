"""Streams over the events table, fed in slices that come out of order, beside the batch rows that SQL says remain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.streaming.late import late_window_totals, pairs_or_alone
from tessera.streaming.timers import idle_users

_DAY = "timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', ts)"
_SQL_DAY = "date_diff('day', date '1970-01-01', ts::date)"


def late_arrivals(events):
    """events with ``arrival``: slices of six days, and every eleventh event two slices late."""
    return events.withColumn("arrival", F.expr(f"cast({_DAY} div 6 + if(event_id % 11 = 0, 2, 0) as int)"))


@register(
    "stream_late_rows",
    f"""with a as (select *, {_SQL_DAY} // 6 + case when event_id % 11 = 0 then 2 else 0 end as arrival, time_bucket(interval '1 hour', ts) as w from events),
       tops as (select arrival, max(ts) as top from a group by 1),
       marks as (select arrival, max(top) over (order by arrival rows between unbounded preceding and 1 preceding) - interval 12 hour as mark from tops),
       last as (select max(ts) - interval 12 hour as mark from a)
       select w, count(*) as n, round(sum(value), 6) as v from a join marks using (arrival), last
       where (marks.mark is null or w + interval 1 hour > marks.mark) and w + interval 1 hour <= last.mark group by w""",
)
def stream_late_rows(t):
    return late_window_totals(late_arrivals(t("events")), "arrival", "1 hour", "12 hours").rows.select("w", "n", F.round("v", 6).alias("v"))


@register(
    "stream_idle_users",
    """with a as (select *, case when ts - lag(ts) over u <= interval 6 hour then 0 else 1 end as f from events window u as (partition by user_id order by ts, event_id)),
       b as (select *, sum(f) over (partition by user_id order by ts, event_id) as g from a),
       s as (select user_id, g, min(ts) as start, max(ts) as stop, count(*) as n, count(distinct event_type) as kinds, list(event_id order by ts, event_id) as ids from b group by user_id, g),
       n as (select *, lead(start) over (partition by user_id order by start) as next from s)
       select user_id, epoch_us(start) as start, epoch_us(stop) as stop, n, kinds, ids from n where next is not null or stop + interval 6 hour <= (select max(ts) - interval 1 hour from events)""",
)
def stream_idle_users(t):
    return idle_users(t("events").withColumn("arrival", F.expr(f"cast({_DAY} div 8 as int)")), "arrival", 6 * 3600, "1 hour").rows


@register(
    "stream_outer_join",
    """with p as (select * from events where event_type = 'purchase'), c as (select * from events where event_type = 'click'),
       last as (select least((select max(ts) from p), (select max(ts) from c)) - interval 2 hour as mark)
       select p.event_id as a, c.event_id as b from p left join c on p.user_id = c.user_id and c.ts >= p.ts and c.ts <= p.ts + interval 3 hour, last
       where c.event_id is not null or p.ts + interval 3 hour <= last.mark""",
)
def stream_outer_join(t):
    events = t("events").withColumn("arrival", F.expr(f"cast({_DAY} div 8 as int)"))
    return pairs_or_alone(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), "arrival", "3 hours", "2 hours").rows
