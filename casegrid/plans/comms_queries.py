"""Queries over communications: the event stream read as communications, and the tables of messages and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.operators import comms as C
from casegrid.session import table

_C = """with comms as (select event_id as id, 'C' || (user_id % 4) as case_id, cast(user_id as varchar) as sender,
 json_extract_string(props, '$.k') as receiver, case when event_type in ('purchase', 'signup') then 'call' else 'message' end as type,
 ts as "timestamp", case when event_type in ('purchase', 'signup') then cast(floor(value * 60) as bigint) end as duration_seconds from events),
ends as (select *, 'out' as role, sender as contact from comms where length(sender) > 0
 union all select *, 'in' as role, receiver as contact from comms where length(receiver) > 0)
"""


def _on_events(operator, **kw):
    return lambda spark, d: operator(C.from_events(table(spark, d, "events")), **kw)


def _comms_union(spark, d):
    rows = C.from_messages_and_calls(table(spark, d, "messages"), table(spark, d, "calls"))
    return rows.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sender").alias("senders"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).cast("long").alias("seconds"))


def _series(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("contact"), F.col("c_name").alias("name"))
    return C.top_contact_series(C.from_events(table(spark, d, "events")), names)


QUERIES = {
    "s28_comms_union": _comms_union,
    "a1_case_statistics": _on_events(C.case_statistics),
    "a2_top_senders": _on_events(C.top_senders),
    "a7_contact_roles": _on_events(C.contact_roles),
    "a8_flows": _on_events(C.flows),
    "a10_contact_interactions": _on_events(C.contact_interactions),
    "a13_call_duration_statistics": _on_events(C.call_duration_statistics),
    "a16_daily_participants": _on_events(C.daily_participants),
    "a17_daily_anomalies": _on_events(C.daily_anomalies),
    "a21_duration_buckets": _on_events(C.duration_buckets),
    "a22_response_statistics": _on_events(C.response_statistics),
    "w2_replies": _on_events(C.replies),
    "w3_cumulative_counts": _on_events(C.cumulative_counts),
    "w4_gaps": _on_events(C.gaps_between),
    "p_activity_day": _on_events(C.activity_timeline),
    "p_activity_hour": _on_events(C.activity_timeline, unit="hour"),
    "p_activity_week": _on_events(C.activity_timeline, unit="week"),
    "p_activity_month": _on_events(C.activity_timeline, unit="month"),
    "p_heatmap": _on_events(C.weekday_hour_heatmap),
    "p_peak_cell": _on_events(C.peak_cell),
    "p_call_minutes": _on_events(C.call_minutes),
    "p_top_contact_series": _series,
    "p_calls_by_hour": _on_events(C.calls_by_hour),
    "p_sankey_flows": _on_events(C.sankey_flows),
    "p_spikes": _on_events(C.spikes),
    "p_top_spikes": _on_events(C.top_spikes),
    "p_unusual_contacts": _on_events(C.unusual_contacts, least=5, limit=1.5),
    "p_behaviour_changes": _on_events(C.behaviour_changes, limit=1.5),
    "p_anomaly_summary": _on_events(C.anomaly_summary),
    "p_gap_histogram": _on_events(C.gap_histogram),
    "p_zero_filled_daily": _on_events(C.zero_filled_daily),
    "p_temporal_evolution": _on_events(C.temporal_evolution),
    "p_volume_histogram": _on_events(C.volume_histogram),
    "p_timeline": _on_events(C.timeline),
}

_REPLIES = """, r as (select id, sender, receiver, "timestamp" as t, lag(receiver) over w as "to", lag("timestamp") over w as before_t from comms
 where length(sender) > 0 and length(receiver) > 0 window w as (partition by least(sender, receiver), greatest(sender, receiver) order by "timestamp", id)),
rep as (select id, sender, receiver, round((epoch_us(t) - epoch_us(before_t)) / 6e7, 6) as minutes from r
 where "to" = sender and (epoch_us(t) - epoch_us(before_t)) / 6e7 > 0 and (epoch_us(t) - epoch_us(before_t)) / 6e7 < 1440)
"""
_DAYS = """, days as (select cast("timestamp" as date) as day, count(*) as n from comms group by 1)"""
_GAPS = """, g as (select sender, lag("timestamp") over (partition by sender order by "timestamp", id) as from_at, "timestamp" as to_at from comms where length(sender) > 0),
gaps as (select sender, from_at, to_at, round((epoch_us(to_at) - epoch_us(from_at)) / 3.6e9, 6) as gap_hours from g where from_at is not null)"""
_SPIKES = """, v as (select date_trunc('hour', "timestamp") as bucket, count(*) as volume from comms group by 1),
s as (select avg(volume) as mean, stddev_samp(volume) as std from v),
sp as (select bucket, volume, round((volume - mean) / std, 6) as z from v, s where volume > mean + 2.0 * std)"""


def _activity(unit: str) -> str:
    return _C + f"""select cast(date_trunc('{unit}', "timestamp") as timestamp) as bucket, count(*) filter (type = 'message') as messages, count(*) filter (type = 'call') as calls from comms group by 1"""


SQL = {
    "s28_comms_union": """select case_id, type, count(*) as n, count(distinct sender) as senders, cast(coalesce(sum(duration_seconds), 0) as bigint) as seconds from (
 select case_id, 'message' as type, sender_digits as sender, null as duration_seconds from messages
 union all select case_id, 'call', caller_digits, duration_seconds from calls) group by 1, 2""",
    "a1_case_statistics": _C + """select case_id, count(*) filter (type = 'message') as messages, count(*) filter (type = 'call') as calls, min("timestamp") as first_at, max("timestamp") as last_at from comms group by 1""",
    "a2_top_senders": _C + "select sender, count(*) as n from comms where length(sender) > 0 group by 1 order by n desc, sender limit 10",
    "a7_contact_roles": _C + """select contact, count(*) filter (type = 'message' and role = 'out') as sent, count(*) filter (type = 'message' and role = 'in') as received,
 count(*) filter (type = 'call' and role = 'out') as made, count(*) filter (type = 'call' and role = 'in') as answered, count(*) as total from ends group by 1""",
    "a8_flows": _C + "select sender as src, receiver as dst, count(*) as weight, count(*) filter (type = 'call') as calls, count(*) filter (type = 'message') as messages from comms where length(sender) > 0 and length(receiver) > 0 group by 1, 2",
    "a10_contact_interactions": _C + "select contact, count(*) filter (type = 'message') as messages, count(*) filter (type = 'call') as calls, count(*) as total from ends group by 1 having count(*) >= 5",
    "a13_call_duration_statistics": _C + """select count(*) as n, round(avg(m), 6) as mean, round(median(m), 6) as median, round(sum(m), 6) as total, round(min(m), 6) as least, round(max(m), 6) as most
 from (select duration_seconds / 60.0 as m from comms where type = 'call' and duration_seconds > 0)""",
    "a16_daily_participants": _C + """select d.day, d.n, coalesce(p.participants, 0) as participants from (select cast("timestamp" as date) as day, count(*) as n from comms group by 1) d
 left join (select cast("timestamp" as date) as day, count(distinct contact) as participants from ends group by 1) p on d.day = p.day""",
    "a17_daily_anomalies": _C + """, days as (select cast("timestamp" as date) as day, count(*) as n, count(distinct sender) as senders,
 count(*) filter (hour("timestamp") >= 23 or hour("timestamp") <= 5) as late_night from comms group by 1), s as (select avg(n) as mean, stddev_samp(n) as std from days)
select day, n, senders, isodow(day) >= 6 as is_weekend, late_night, round((n - mean) / std, 6) as deviation, n > mean + 2.0 * std as spike from days, s""",
    "a21_duration_buckets": _C + """select case when duration_seconds / 60.0 < 1 then '< 1 min' when duration_seconds / 60.0 < 5 then '1-5 min' when duration_seconds / 60.0 < 15 then '5-15 min' else '> 15 min' end as bucket, count(*) as n
 from comms where type = 'call' and duration_seconds > 0 group by 1""",
    "a22_response_statistics": _C + _REPLIES + "select count(*) as n, round(avg(case when minutes <= 5 then 1.0 else 0.0 end), 6) as quick_share, round(avg(minutes), 6) as mean, round(median(minutes), 6) as median, round(min(minutes), 6) as least, round(max(minutes), 6) as most from rep",
    "w2_replies": _C + _REPLIES + "select * from rep",
    "w3_cumulative_counts": _C + """, b as (select case_id, date_trunc('hour', "timestamp") as bucket, count(*) filter (type = 'message') as m, count(*) filter (type = 'call') as c from comms group by 1, 2)
select case_id, bucket, cast(sum(m) over w as bigint) as messages, cast(sum(c) over w as bigint) as calls from b window w as (partition by case_id order by bucket rows unbounded preceding)""",
    "w4_gaps": _C + _GAPS + "select * from gaps where (epoch_us(to_at) - epoch_us(from_at)) / 3.6e9 > 24",
    "p_activity_day": _activity("day"),
    "p_activity_hour": _activity("hour"),
    "p_activity_week": _activity("week"),
    "p_activity_month": _activity("month"),
    "p_heatmap": _C + """select g.weekday, g.hour, coalesce(s.n, 0) as n from (select cast(i // 24 as int) as weekday, cast(i % 24 as int) as hour from range(168) t(i)) g
 left join (select isodow("timestamp") - 1 as weekday, hour("timestamp") as hour, count(*) as n from comms group by 1, 2) s on g.weekday = s.weekday and g.hour = s.hour""",
    "p_peak_cell": _C + """select cast(isodow("timestamp") - 1 as int) as weekday, cast(hour("timestamp") as int) as hour, count(*) as n from comms group by 1, 2 order by n desc, hour, weekday limit 1""",
    "p_call_minutes": _C + """select id, "timestamp", round(coalesce(duration_seconds, 0) / 60.0, 6) as minutes from comms where type = 'call'""",
    "p_top_contact_series": _C + """, top as (select contact, c_name as name, count(*) as total from ends join customer on contact = cast(c_custkey as varchar) group by 1, 2 order by total desc, contact limit 5)
select e.contact, name, cast("timestamp" as date) as day, count(*) as n from ends e join top t on e.contact = t.contact group by 1, 2, 3""",
    "p_calls_by_hour": _C + """select cast(hour("timestamp") as int) as hour, count(*) as n, round(avg(duration_seconds / 60.0), 6) as mean_minutes from comms where type = 'call' and duration_seconds > 0 group by 1""",
    "p_sankey_flows": _C + """, f as (select sender as src, receiver as dst, count(*) as weight from comms where length(sender) > 0 and length(receiver) > 0 group by 1, 2),
top as (select c from (select src as c, weight from f union all select dst, weight from f) group by 1 order by sum(weight) desc, c limit 15)
select * from f where src in (select c from top) and dst in (select c from top) order by weight desc, src, dst limit 100""",
    "p_spikes": _C + _SPIKES + "select * from sp",
    "p_top_spikes": _C + _SPIKES + "select * from sp order by volume desc, bucket limit 10",
    "p_unusual_contacts": _C + """, t as (select contact, count(*) as total from ends group by 1 having count(*) >= 5), s as (select avg(total) as mean, stddev_pop(total) as std from t)
select contact, total, round((total - mean) / std, 6) as z, case when total > mean then 'High Activity' else 'Low Activity' end as label from t, s where abs((total - mean) / std) > 1.5""",
    "p_behaviour_changes": _C + """, d as (select cast("timestamp" as date) as day, count(*) as n from comms group by 1), p as (select cast("timestamp" as date) as day, count(distinct contact) as participants from ends group by 1),
w as (select day, n, row_number() over (order by day) as i, avg(n) over (order by day rows between 7 preceding and 1 preceding) as mean, stddev_samp(n) over (order by day rows between 7 preceding and 1 preceding) as std from d)
select w.day, n, participants, round((n - mean) / std, 6) as z, round((n - mean) / mean * 100, 6) as change_pct from w join p on w.day = p.day where i > 7 and std > 0 and abs((n - mean) / std) > 1.5""",
    "p_anomaly_summary": _C + """select count(*) as n, round(avg(case when hour("timestamp") >= 23 or hour("timestamp") <= 5 then 1.0 else 0.0 end) * 100, 6) as late_night_pct,
 round(avg(case when isodow("timestamp") >= 6 then 1.0 else 0.0 end) * 100, 6) as weekend_pct from comms""",
    "p_gap_histogram": _C + _GAPS + "select cast(floor(gap_hours) as bigint) as hours, count(*) as n from gaps group by 1",
    "p_zero_filled_daily": _C + _DAYS + """select cast(g.day as date) as day, coalesce(n, 0) as n from (select unnest(generate_series((select min(day) from days)::timestamp, (select max(day) from days)::timestamp, interval 1 day)) as day) g left join days d on d.day = cast(g.day as date)""",
    "p_temporal_evolution": _C + """, s as (select min(epoch_us("timestamp")) as lo, max(epoch_us("timestamp")) as hi from comms where length(sender) > 0 and length(receiver) > 0),
x as (select *, cast(floor((epoch_us("timestamp") - lo) * 10 / (hi - lo)) as int) as w from comms, s where length(sender) > 0 and length(receiver) > 0),
e as (select w, count(*) as n, count(distinct (sender, receiver)) as edges from x where w < 10 group by 1),
n as (select w, count(distinct c) as nodes from (select w, sender as c from x where w < 10 union all select w, receiver from x where w < 10) group by 1)
select e.w as "window", nodes, edges, round(case when nodes > 1 then edges / (nodes * (nodes - 1)) else 0.0 end, 6) as density, n.n as n from e join (select n.*, e2.n from n join e e2 on n.w = e2.w) n on e.w = n.w""",
    "p_volume_histogram": _C + """, v as (select date_trunc('hour', "timestamp") as h, count(*) as v from comms group by 1), s as (select min(v) as lo, max(v) as hi from v)
select cast(least(floor((v - lo) * 50 / greatest(hi - lo, 1)), 49) as int) as bin, count(*) as n from v, s group by 1""",
    "p_timeline": _C + """select "timestamp", case_id, type, id, substr(sender || ' -> ' || receiver, 1, 100) as summary from comms where "timestamp" is not null""",
}
