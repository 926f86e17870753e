"""All queries of the core: name to (function of session and folder), and SQL twins where SQL can express them."""

from __future__ import annotations

from casegrid.operators import comms, guard, sessions, timestamps
from casegrid.plans import comms_queries, graph_queries, lookup_queries, text_queries
from casegrid.session import table
from casegrid.streaming import windows


def _guarded(spark, d):
    guard.register(spark, d)
    return guard.run(spark, "select app, count(*) as n from messages group by app order by n desc, app limit 50")


def _windows(spark, d):
    return windows.window_counts(comms.from_events(table(spark, d, "events")))


def _sliding(spark, d):
    return windows.window_counts(comms.from_events(table(spark, d, "events")), width="2 hours", slide="1 hour")


QUERIES = {
    "p1_found": sessions.p1_found,
    "p1_event_sessions": sessions.p1_event_sessions,
    "p4_found": timestamps.p4_found,
    "q1_guarded_sql": _guarded,
    "st_window_counts": _windows,
    "st_sliding_counts": _sliding,
    **comms_queries.QUERIES,
    **lookup_queries.QUERIES,
    **graph_queries.QUERIES,
    **text_queries.QUERIES,
}
SQL = {
    "p1_event_sessions": sessions.P1_EVENTS_SQL,
    "q1_guarded_sql": "select app, count(*) as n from messages group by app order by n desc, app limit 50",
    "st_window_counts": comms_queries._C + """select date_trunc('hour', "timestamp") as start_at, date_trunc('hour', "timestamp") + interval 1 hour as end_at, count(*) filter (type = 'message') as messages, count(*) filter (type = 'call') as calls from comms group by 1, 2""",
    "st_sliding_counts": comms_queries._C + """select date_trunc('hour', "timestamp") - to_hours(k) as start_at, date_trunc('hour', "timestamp") - to_hours(k) + interval 2 hour as end_at, count(*) filter (type = 'message') as messages, count(*) filter (type = 'call') as calls
 from comms, (values (0), (1)) v(k) group by 1, 2""",
    **comms_queries.SQL,
    **lookup_queries.SQL,
    **graph_queries.SQL,
    **text_queries.SQL,
}
