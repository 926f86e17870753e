"""Lookups and named patterns over the case tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casegrid.functions import text as T
from casegrid.operators import lookups as L
from casegrid.operators.timestamps import device_facts
from casegrid.session import table


def _m(operator, *args, **kw):
    return lambda spark, d: operator(table(spark, d, "messages"), *args, **kw)


def _on(name, operator, *args, **kw):
    return lambda spark, d: operator(table(spark, d, name), *args, **kw)


def _two(a, b, operator, *args, **kw):
    return lambda spark, d: operator(table(spark, d, a), table(spark, d, b), *args, **kw)


def _ego(spark, d):
    return L.ego_targets(*(table(spark, d, t) for t in ("messages", "calls", "contacts")), case_id="CS-00000000")


def _activity(spark, d):
    return L.contact_activity(*(table(spark, d, t) for t in ("messages", "calls", "contacts")))


def _count_records(spark, d):
    out = None
    for name in ("messages", "calls", "contacts", "media", "devices"):
        rows = table(spark, d, name).groupBy("case_id").agg(F.count("*").alias("n")).withColumn("type", F.lit(name.rstrip("s")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _new_rows(spark, d):
    m = table(spark, d, "messages").select("case_id", "source_path", "msg_id")
    return L.new_rows(m, m.where("source_path like '%db_1%'"), ["case_id", "msg_id"]).groupBy("case_id").agg(F.count("*").alias("n"))


def _upsert(spark, d):
    rows = L.upsert_last(table(spark, d, "media").select("sha256", "media_id", "source_path"), "sha256", ["media_id"])
    return rows.select("sha256", "media_id")


def _last_days(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return L.latest_days(e.where("event_type = 'view'"), "ts", 7).select("event_id")


def _set_ops(spark, d):
    m, c = table(spark, d, "messages"), table(spark, d, "calls")
    a, b = m.select(F.col("sender_digits").alias("x")), c.select(F.col("caller_digits").alias("x"))
    a, b = a.where("length(x) > 0"), b.where("length(x) > 0")
    return a.intersect(b).select("x", F.lit("both").alias("side")).union(a.exceptAll(a.intersect(b)).distinct().join(b.distinct(), "x", "left_anti").select("x", F.lit("messages").alias("side")))


def _newest(spark, d, rows, limit=100):
    facts = device_facts(table(spark, d, "devices"), table(spark, d, "device_zones"))
    return L.newest(rows, facts, limit).select("msg_id", "utc_ms")


def _busiest(rows):
    """The receiver of the most rows, ties by number, as a scalar."""
    counts = rows.where("length(receiver_digits) > 0").groupBy("receiver_digits").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("receiver_digits", F.struct("n", "receiver_digits")).alias("r")).scalar()


def _found(spark, d):
    return L.search_messages(table(spark, d, "messages"), ["CS-00000000", "CS-00000002"], "the", "91")


def _media_entities(spark, d):
    m = table(spark, d, "media_enhancements")
    found = m.select("id", F.explode(T.entities(F.col("extracted_text"), "potential_names")).alias("value")).select("id", F.lit("potential_names").alias("kind"), "value")
    return L.search_entities(found, m, "CS-00000000", "potential_names", "ROAD")


def _scaled(spark, d):
    """Messages and calls of each case as shares of the most of any case."""
    n = _count_records(spark, d).where(F.col("type").isin("message", "call"))
    return n.select("case_id", "type", F.round(F.col("n") / F.greatest(F.max("n").over(Window.partitionBy("type")), F.lit(1)), 6).alias("share"))


def _totals(spark, d):
    """Rows of each kind, of each case and in all (nulls), by a cube."""
    return _count_records(spark, d).cube("case_id", "type").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


QUERIES = {
    "q6_by_suffix": lambda s, d: L.by_suffix(table(s, d, "messages"), "25").select("msg_id", "sender_digits", "timestamp").distinct(),
    "q6_newest": lambda s, d: _newest(s, d, L.by_suffix(table(s, d, "messages"), "25")),
    "q7_by_prefix": lambda s, d: L.by_prefix(table(s, d, "messages"), "9184").select("msg_id", "sender_digits").distinct(),
    "q8_text_search": lambda s, d: L.text_search(table(s, d, "messages"), "RECEIPT").select("msg_id", "text").distinct(),
    "q8_newest": lambda s, d: _newest(s, d, L.text_search(table(s, d, "messages"), "RECEIPT")),
    "q9_call_summary": _on("calls", L.call_summary),
    "q10_find_contacts": _on("contacts", L.find_contacts, ["CS-00000000", "CS-00000001"], "a", "9"),
    "q11_search_messages": lambda s, d: _found(s, d).select("msg_id", "sender_digits", "text").distinct(),
    "q11_newest": lambda s, d: _newest(s, d, _found(s, d), 50),
    "q14_search_entities": _media_entities,
    "t8_case_samples": lambda s, d: L.case_samples(*(table(s, d, t) for t in ("messages", "contacts", "calls"))).groupBy("kind").agg(F.count("*").alias("n")),
    "t10_sample": lambda s, d: L.sample_rows(table(s, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source")), "source", "doc_id", 20).groupBy("source").agg(F.count("*").alias("n")),
    "v8_wallets": _on("messages", L.wallets_in),
    "x10_crypto_messages": _on("messages", L.crypto_messages),
    "w10_scaled_by_most": _scaled,
    "a18_totals": _totals,
    "q12_count_records": _count_records,
    "q13_case_summary": lambda s, d: table(s, d, "cases").join(_count_records(s, d).groupBy("case_id").agg(F.sum("n").alias("records")), "case_id", "left").select("case_id", F.coalesce("records", F.lit(0)).alias("records")),
    "q15_ego_targets": _ego,
    "q16_contact_picker": lambda s, d: table(s, d, "contacts").select(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif("phone_raw", F.lit("")), F.nullif("email", F.lit(""))).alias("label")).where("label is not null").distinct(),
    "q17_provenance": _on("media_enhancements", L.provenance),
    "q19_media_search": _on("media", L.media_search, "statement"),
    "j1_active_contacts": _two("messages", "contacts", L.active_contacts),
    "j3_contact_activity": _activity,
    "j5_named_senders": _two("messages", "contacts", L.named_ends),
    "j9_case_pairs": lambda s, d: _pairs(s, d),
    "j10_new_rows": _new_rows,
    "k4_upsert_last": _upsert,
    "k7_first_by_hash": _on("media", L.first_by_hash),
    "a3_distinct_phones": lambda s, d: table(s, d, "contacts").groupBy("case_id").agg(F.count("*").alias("n"), F.countDistinct("phone_digits").alias("phones")),
    "a5_enhancement_stats": _on("media_enhancements", L.enhancement_stats),
    "a6_shared_phones": lambda s, d: _shared(s, d, "phone_digits"),
    "a6_shared_emails": lambda s, d: _shared(s, d, "email"),
    "a12_confidence_bands": _on("media_enhancements", L.confidence_bands),
    "a19_app_counts": lambda s, d: table(s, d, "messages").groupBy(F.lower(F.trim("app")).alias("app")).agg(F.count("*").alias("n"), F.countDistinct("msg_id").alias("messages"), F.round(F.try_divide(F.countDistinct("msg_id"), F.count("*")), 6).alias("success_rate")),
    "u2_endpoints": _two("messages", "calls", L.endpoints),
    "u5_intersect_except": _set_ops,
    "v1_phone_contains": lambda s, d: table(s, d, "contacts").where(F.contains("phone_digits", F.lit("123"))).select("contact_id", "name").distinct(),
    "v2_message_contains": lambda s, d: table(s, d, "messages").where(F.contains("text", F.lit("receipt"))).select("msg_id").distinct(),
    "v3_long_calls": lambda s, d: table(s, d, "calls").where("duration_seconds > 300").select("call_id", "duration_seconds").distinct(),
    "v4_image_ocr": lambda s, d: table(s, d, "media").where((F.col("media_type") == "image") & F.contains("ocr_text", F.lit("officer"))).select("media_id").distinct(),
    "v5_date_range": lambda s, d: table(s, d, "call_logs").where("timestamp between timestamp_ntz'2024-05-01 00:00:00' and timestamp_ntz'2024-05-31 23:59:59'").select("id").distinct(),
    "v6_senders_of": lambda s, d: table(s, d, "messages").where(F.contains("text", F.lit("invoice")) & (F.length("sender_digits") > 0)).select("sender_digits").distinct(),
    "v9_callers_of": lambda s, d: L.callers_of(table(s, d, "calls"), table(s, d, "contacts"), "919151398781"),
    "v10_by_hash": lambda s, d: table(s, d, "media").where(F.startswith("sha256", F.lit("d3"))).select("media_id", "sha256").distinct(),
    "v11_named": lambda s, d: table(s, d, "contacts").where(F.contains("name", F.lit("Sharma"))).select("contact_id", "name").distinct().orderBy("contact_id").limit(100),
    "v12_regex": lambda s, d: table(s, d, "messages").where(F.rlike("text", F.lit("(?i).*wallet.*"))).select("msg_id").distinct(),
    "v13_foreign_calls": lambda s, d: table(s, d, "calls").where(~F.startswith("caller_digits", F.lit("91"))).select("call_id").distinct(),
    "v14_sent_to": lambda s, d: table(s, d, "messages").where((F.col("receiver_digits") == _busiest(table(s, d, "messages"))) & (F.length("sender_digits") > 0)).select("sender_digits").distinct(),
    "v16_between_names": lambda s, d: L.between_names(table(s, d, "messages"), table(s, d, "contacts"), "i", "a"),
    "v17_last_days": _last_days,
    "v18_frequent_callers": _on("calls", L.frequent_callers),
}


def _shared(spark, d, column):
    rows = table(spark, d, "contacts").where(F.length(F.trim(column)) > 0).groupBy(F.col(column).alias("value"))
    rows = rows.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"), F.array_join(F.array_sort(F.collect_set("case_id")), ",").alias("case_ids"))
    return rows.where("cases > 1")


def _pairs(spark, d):
    own = table(spark, d, "contacts").where("length(phone_digits) > 0").select("case_id", "phone_digits").distinct()
    a, b = own.withColumnRenamed("case_id", "case_a"), own.withColumnRenamed("case_id", "case_b")
    return a.join(b, "phone_digits").where("case_a < case_b").groupBy("case_a", "case_b").agg(F.count("*").alias("shared"))


_NAMES = """with names as (select case_id, phone_digits as digits, arg_min(name, (contact_id, name)) as name from contacts where length(phone_digits) > 0 and length(trim(name, ' ')) > 0 group by 1, 2)
"""
_ENDS = """select case_id, sender_digits as digits from messages union select case_id, receiver_digits from messages union select case_id, caller_digits from calls union select case_id, receiver_digits from calls"""
_COUNTS = " union all ".join(f"select case_id, count(*) as n, '{t.rstrip('s')}' as type from {t} group by 1" for t in ("messages", "calls", "contacts", "media", "devices"))


def _shared_sql(c: str) -> str:
    return f"""select {c} as value, count(*) as n, count(distinct case_id) as cases, array_to_string(list_sort(list(distinct case_id)), ',') as case_ids from contacts
 where length(trim({c}, ' ')) > 0 group by 1 having count(distinct case_id) > 1"""


SQL = {
    "q6_by_suffix": "select distinct msg_id, sender_digits, \"timestamp\" from messages where sender_digits like '%25'",
    "q7_by_prefix": "select distinct msg_id, sender_digits from messages where sender_digits like '9184%'",
    "q8_text_search": "select distinct msg_id, text from messages where text ilike '%receipt%'",
    "q14_search_entities": """with e as (select id, case_id, file_path, media_type, unnest(regexp_extract_all(extracted_text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) as value from media_enhancements where case_id = 'CS-00000000')
select distinct id, file_path, media_type, 'potential_names' as kind, value from e where value ilike '%road%'""",
    "t8_case_samples": """select kind, cast(sum(least(n, m)) as bigint) as n from (select case_id, 'message' as kind, count(distinct msg_id) as n, 100 as m from messages where case_id is not null group by 1
 union all select case_id, 'contact', count(distinct contact_id), 50 from contacts where case_id is not null group by 1 union all select case_id, 'call', count(distinct call_id), 50 from calls where case_id is not null group by 1) group by 1""",
    "t10_sample": "select source, least(count(*), 20) as n from (select lower(trim(source, ' ')) as source from documents) group by 1",
    "v8_wallets": "with w as (select msg_id, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\\b') || regexp_extract_all(text, '(?i)\\b0x[a-fA-F0-9]{40}\\b'))) as wallet from messages) select distinct msg_id, wallet from w",
    "x10_crypto_messages": "select distinct case_id, msg_id from messages where regexp_matches(lower(text), '" + "|".join(L.CRYPTO_WORDS) + "')",
    "w10_scaled_by_most": f"select case_id, type, round(n / max(n) over (partition by type), 6) as share from ({_COUNTS}) where type in ('message', 'call')",
    "a18_totals": f"select case_id, type, cast(sum(n) as bigint) as n, cast(grouping(case_id, type) as bigint) as level from ({_COUNTS}) group by cube (case_id, type)",
    "q9_call_summary": "select case_id, count(*) as n, cast(sum(duration_seconds) as bigint) as total, round(avg(duration_seconds), 6) as mean, max(duration_seconds) as longest from calls group by 1",
    "q10_find_contacts": """select distinct contact_id, 'Contact: ' || coalesce(name, 'Unknown') || ', Phone: ' || coalesce(phone_raw, 'N/A') as document from contacts
 where case_id in ('CS-00000000', 'CS-00000001') and name ilike '%a%' and phone_digits ilike '%9%' order by contact_id, document limit 100""",
    "q11_search_messages": "select distinct msg_id, sender_digits, text from messages where case_id in ('CS-00000000', 'CS-00000002') and text ilike '%the%' and sender_digits like '%91%'",
    "q12_count_records": _COUNTS,
    "q13_case_summary": f"select c.case_id, cast(coalesce(r.n, 0) as bigint) as records from cases c left join (select case_id, sum(n) as n from ({_COUNTS}) group by 1) r on c.case_id = r.case_id",
    "q15_ego_targets": _NAMES + f"""select distinct e.digits, coalesce(n.name, e.digits) as label from ({_ENDS}) e left join names n on e.case_id = n.case_id and e.digits = n.digits
 where e.case_id = 'CS-00000000' and length(e.digits) > 0 order by label, e.digits limit 200""",
    "q16_contact_picker": "select distinct coalesce(nullif(trim(name, ' '), ''), nullif(phone_raw, ''), nullif(email, '')) as label from contacts where coalesce(nullif(trim(name, ' '), ''), nullif(phone_raw, ''), nullif(email, '')) is not null",
    "q17_provenance": """select case_id, count(*) filter (case_id is not null and file_path is not null and sha256_hash is not null and created_at is not null) as "full", count(*) as n,
 round(count(*) filter (case_id is not null and file_path is not null and sha256_hash is not null and created_at is not null) / count(*), 6) as share from media_enhancements group by 1""",
    "q19_media_search": """with h as (select media_id, coalesce(contains(lower(ocr_text), 'statement'), false) as o, coalesce(contains(lower(caption), 'statement'), false) as c from media where lower(trim(media_type)) = 'image')
select distinct media_id, case when o and c then 'both' when o then 'ocr' else 'caption' end as match_type from h where o or c""",
    "j1_active_contacts": _NAMES + """select s.case_id, s.digits, s.n, names.name from (select case_id, sender_digits as digits, count(distinct msg_id) as n from messages where length(sender_digits) > 0 group by 1, 2) s
 join names on s.case_id = names.case_id and s.digits = names.digits order by s.n desc, s.case_id, s.digits limit 10""",
    "j3_contact_activity": _NAMES + """, r as (select case_id, sender_digits as digits, 'sent' as kind from messages union all select case_id, receiver_digits, 'received' from messages
 union all select case_id, caller_digits, 'made' from calls union all select case_id, receiver_digits, 'answered' from calls),
k as (select case_id, digits, count(*) filter (kind = 'sent') as sent, count(*) filter (kind = 'received') as received, count(*) filter (kind = 'made') as made, count(*) filter (kind = 'answered') as answered from r where length(digits) > 0 group by 1, 2)
select n.case_id, n.digits, n.name, coalesce(sent, 0) as sent, coalesce(received, 0) as received, coalesce(made, 0) as made, coalesce(answered, 0) as answered from names n left join k on n.case_id = k.case_id and n.digits = k.digits""",
    "j5_named_senders": _NAMES + """select s.case_id, coalesce(n.name, 'Unknown') as name, cast(sum(s.n) as bigint) as n from (select case_id, sender_digits as digits, count(distinct msg_id) as n from messages where length(sender_digits) > 0 group by 1, 2) s
 left join names n on s.case_id = n.case_id and s.digits = n.digits group by 1, 2""",
    "j9_case_pairs": "with o as (select distinct case_id, phone_digits from contacts where length(phone_digits) > 0) select a.case_id as case_a, b.case_id as case_b, count(*) as shared from o a join o b on a.phone_digits = b.phone_digits and a.case_id < b.case_id group by 1, 2",
    "j10_new_rows": "select case_id, count(distinct msg_id) as n from messages m where (case_id, msg_id) not in (select (case_id, msg_id) from messages where source_path like '%db_1%') group by 1",
    "k4_upsert_last": "select sha256, max(media_id) as media_id from media where sha256 is not null group by 1",
    "k7_first_by_hash": "select case_id, sha256, min(media_id) as media_id, count(*) as copies from media where sha256 is not null group by 1, 2",
    "a3_distinct_phones": "select case_id, count(*) as n, count(distinct phone_digits) as phones from contacts group by 1",
    "a5_enhancement_stats": "select media_type, count(*) as n, round(avg(confidence), 6) as confidence, cast(sum(length(extracted_text)) as bigint) as chars from media_enhancements group by rollup (media_type)",
    "a6_shared_phones": _shared_sql("phone_digits"),
    "a6_shared_emails": _shared_sql("email"),
    "a12_confidence_bands": """select coalesce(nullif(lower(trim(language, ' ')), ''), 'unknown') as language, count(*) as n, count(*) filter (confidence > 0.8) as high, count(*) filter (confidence < 0.5) as low,
 count(*) filter (coalesce(length(trim(extracted_text, ' ')), 0) = 0) as empty from media_enhancements group by 1""",
    "a19_app_counts": "select lower(trim(app, ' ')) as app, count(*) as n, count(distinct msg_id) as messages, round(count(distinct msg_id) / count(*), 6) as success_rate from messages group by 1",
    "u2_endpoints": f"select case_id, digits from ({_ENDS}) where length(digits) > 0",
    "u5_intersect_except": """with a as (select distinct sender_digits as x from messages where length(sender_digits) > 0), b as (select distinct caller_digits as x from calls where length(caller_digits) > 0)
select x, 'both' as side from (select x from a intersect select x from b) union all select x, 'messages' from (select x from a except select x from b)""",
    "v1_phone_contains": "select distinct contact_id, name from contacts where contains(phone_digits, '123')",
    "v2_message_contains": "select distinct msg_id from messages where contains(text, 'receipt')",
    "v3_long_calls": "select distinct call_id, duration_seconds from calls where duration_seconds > 300",
    "v4_image_ocr": "select distinct media_id from media where media_type = 'image' and contains(ocr_text, 'officer')",
    "v5_date_range": "select distinct id from call_logs where \"timestamp\" between timestamp '2024-05-01 00:00:00' and timestamp '2024-05-31 23:59:59'",
    "v6_senders_of": "select distinct sender_digits from messages where contains(text, 'invoice') and length(sender_digits) > 0",
    "v9_callers_of": _NAMES + "select distinct c.caller_digits as digits, n.name from calls c left join names n on c.case_id = n.case_id and c.caller_digits = n.digits where receiver_digits = '919151398781' and length(caller_digits) > 0",
    "v10_by_hash": "select distinct media_id, sha256 from media where sha256 like 'd3%'",
    "v11_named": "select distinct contact_id, name from contacts where contains(name, 'Sharma') order by contact_id limit 100",
    "v12_regex": "select distinct msg_id from messages where contains(lower(text), 'wallet')",
    "v13_foreign_calls": "select distinct call_id from calls where caller_digits not like '91%'",
    "v14_sent_to": """select distinct sender_digits from messages where length(sender_digits) > 0 and receiver_digits = (select receiver_digits from messages
 where length(receiver_digits) > 0 group by 1 order by count(*) desc, receiver_digits desc limit 1)""",
    "v16_between_names": _NAMES + """select distinct m.msg_id, lower(a.name) as s, lower(b.name) as r from messages m join names a on m.case_id = a.case_id and m.sender_digits = a.digits join names b on m.case_id = b.case_id and m.receiver_digits = b.digits
 where (contains(lower(a.name), 'i') and contains(lower(b.name), 'a')) or (contains(lower(a.name), 'a') and contains(lower(b.name), 'i'))""",
    "v17_last_days": "select event_id from events where event_type = 'view' and ts >= (select max(ts) from events where event_type = 'view') - interval 7 day",
    "v18_frequent_callers": "select caller_digits, count(distinct call_id) as n from calls where length(caller_digits) > 0 group by 1 having count(distinct call_id) > 10",
}
