"""Queries of scalar functions, retrieval, linking and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions import persons as N
from casegrid.functions import phones as P
from casegrid.functions import places as PL
from casegrid.functions import records as RC
from casegrid.functions import text as T
from casegrid.operators import linking as K
from casegrid.operators import retrieval as R
from casegrid.operators.comms import from_messages_and_calls
from casegrid.operators.timestamps import device_facts, with_instant
from casegrid.session import table


def _entities(spark, d):
    rows = table(spark, d, "messages").select("msg_id", "text").distinct().select("msg_id", F.explode(T.all_entities(F.col("text"))).alias("e")).where("e.kind <> 'potential_names'")
    return rows.groupBy(F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("e.value").alias("values"), F.min("e.value").alias("least"))


def _suspicious(spark, d):
    m = table(spark, d, "messages").select("msg_id", F.explode(T.suspicious_patterns(F.col("text"), F.col("sender_raw"))).alias("p")).select("msg_id", "p.*").distinct()
    return m.groupBy("pattern_type", "pattern_name", "severity", "confidence").agg(F.count("*").alias("n"))


def _segments(spark, d):
    c = table(spark, d, "messages").select("msg_id", "text").distinct()
    return RC.segment(c).groupBy("record_type", "confidence").agg(F.count("*").alias("n"), F.count_if(F.size("record_fields") > 0).alias("with_fields"))


def _segmented_logs(spark, d):
    c = table(spark, d, "call_logs").select("id", "caller", "callee", "call_type").distinct()
    c = c.select("id", F.concat_ws(" ", "caller", "callee").alias("text"), F.create_map(*[x for k in ("caller", "callee", "call_type") for x in (F.lit(k), F.col(k))]).alias("fields"))
    return RC.segment(c, fields="fields").select("id", "record_type", "confidence", F.col("record_fields")["caller"].alias("caller"), F.col("record_fields")["callee"].alias("callee"), F.col("record_fields")["call_type"].alias("call_type"))


def _name_signals(spark, d):
    c = table(spark, d, "contacts").select("name", P.e164(F.col("phone_raw")).alias("phone")).distinct()
    return c.select("name", "phone", N.detect(F.col("name"), F.col("phone"), in_contacts=True).alias("s")).select("name", "phone", "s.is_name", "s.confidence", "s.script", "s.honorific", "s.tokens", "s.country")


def _coordinates(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(", ", F.round(F.col("value") % 120, 5).cast("string"), (F.col("user_id") % 180).cast("string")).alias("text"))
    return e.select("id", PL.coordinate(F.col("text")).alias("c")).where("c is not null").select("id", "c.latitude", "c.longitude", "c.form")


def _addresses(spark, d):
    c = table(spark, d, "media").select("media_id", F.col("ocr_text").alias("text")).where(F.length("text") < 120).distinct()
    return c.select("media_id", PL.address(F.col("text")).alias("a")).where("a is not null").select("media_id", "a.postal_code", "a.unit", "a.street_number", "a.country", "a.state", "a.confidence")


def _kinds_of_place(spark, d):
    return table(spark, d, "media").select("media_id", PL.kind_of_place(F.coalesce("caption", F.lit("")), F.lit(0)).alias("kind")).distinct()


def _geojson(spark, d):
    return _places(spark, d).select("id", PL.geojson(F.col("latitude"), F.col("longitude"), case=F.col("case_id")).alias("feature"))


def _inferred(spark, d):
    """Commonest kind of each field of contacts and its share of the values that aren't null."""
    c = table(spark, d, "contacts")
    names = ["contact_id", "name", "phone_raw", "phone_digits", "email"]
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), T.field_type(F.col(n)).alias("kind")) for n in names])).alias("p")).select("p.*").where("kind <> 'unknown'")
    per = rows.groupBy("field", "kind").agg(F.count("*").alias("n")).groupBy("field").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return per.select("field", "kind", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _keywords(name, column, words):
    def run(spark, d):
        return table(spark, d, name).select(F.explode(T.keywords_in(F.col(column), words)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    return run


def _scripts(spark, d):
    m = table(spark, d, "messages").select("msg_id", T.main_script(F.col("text")).alias("script")).distinct()
    return m.groupBy("script", T.script_language(F.col("script")).alias("language")).agg(F.count("*").alias("n"))


def _phones(spark, d):
    c = table(spark, d, "contacts")
    return c.select("contact_id", P.digits(F.col("phone_raw")).alias("digits"), P.e164(F.col("phone_raw")).alias("e164"), P.suffix(P.digits(F.col("phone_raw")), 4).alias("suffix")).distinct()


def _with_country(spark, d):
    c = table(spark, d, "calls")
    return c.select("call_id", P.with_country(F.col("caller_raw")).alias("number")).distinct()


def _field_types(spark, d):
    c = table(spark, d, "contacts")
    names = ["contact_id", "name", "phone_raw", "email"]
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), T.field_type(F.col(n)).alias("kind")) for n in names])).alias("p"))
    return rows.groupBy("p.field", "p.kind").agg(F.count("*").alias("n"))


def _schema(spark, d):
    """Share present, least and most length of each field of contacts."""
    c = table(spark, d, "contacts")
    names = ["contact_id", "name", "phone_raw", "email"]
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])).alias("p")).select("p.*")
    v = F.col("value")
    return rows.groupBy("field").agg(F.round(F.avg(v.isNotNull().cast("double")), 6).alias("present"), (F.avg(v.isNotNull().cast("double")) >= 0.9).alias("required"), F.min(F.length(v)).alias("shortest"), F.max(F.length(v)).alias("longest"))


def _similar(spark, d):
    c = table(spark, d, "contacts").where("length(phone_digits) > 0 and name is not null").select("case_id", "phone_digits", "name").distinct()
    a, b = c.withColumnRenamed("name", "a"), c.withColumnRenamed("name", "b")
    rows = a.join(b, ["case_id", "phone_digits"]).where("a < b").withColumn("s", T.name_similarity(F.col("a"), F.col("b")))
    return rows.where("s >= 0.7").select("case_id", "a", "b", F.round("s", 6).alias("score"))


def _hashes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


def _chunked(name, chunk):
    return lambda spark, d: chunk(table(spark, d, name)).select("doc_id", "document", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata")).distinct()


def _index_parts(spark, d):
    t = lambda n: table(spark, d, n)
    return [R.chunk_messages(t("messages")), R.chunk_contacts(t("contacts")), R.chunk_calls(t("calls")), R.chunk_media(t("media")), R.chunk_places(_places(spark, d))]


def _indexed(spark, d):
    return R.case_index(_index_parts(spark, d)).groupBy("case_id", "data_type").agg(F.count("*").alias("n"))


def _hybrid(spark, d):
    return R.retrieve(R.case_index(_index_parts(spark, d)), "whatsapp message about the receipt", ["CS-00000000", "CS-00000001", "CS-00000002"]).drop("document")


def _case_vectors(spark, d):
    e, q = _vectors(spark, d)
    return R.search_cases(e.withColumn("case_id", F.concat(F.lit("L"), "label")), q, ["L1", "L2", "L5"], 5, 1.2)


def _duplicates(spark, d):
    return K.duplicates(table(spark, d, "contacts"))


def _timeline_parts(spark, d):
    facts = device_facts(table(spark, d, "devices"), table(spark, d, "device_zones"))
    at = lambda n: with_instant(table(spark, d, n), facts).withColumn("at", F.timestamp_millis("utc_ms"))
    return K.cross_case_timeline(at("messages"), at("calls"), _places(spark, d))


_QUERIES = ["missing invoice warehouse", "officer compared the guarantee", "password of the encrypted phone"]


def _query_rows(spark):
    return spark.createDataFrame([(i, q) for i, q in enumerate(_QUERIES)], "query_id long, query string")


def _bm25(spark, d):
    return R.bm25(_docs(spark, d), _query_rows(spark))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    return e, q


def _vector(spark, d):
    e, q = _vectors(spark, d)
    return R.vector_search(e, q, 5)


def _vector_filtered(spark, d):
    e, q = _vectors(spark, d)
    return R.vector_search(e.where("label = 3"), q, 5, most_distance=1.0)


def _fused(spark, d):
    a = _bm25(spark, d).where("query_id = 0").select(F.lit("a").alias("list_id"), "doc_id", "rank")
    b = _bm25(spark, d).where("query_id = 1").select(F.lit("b").alias("list_id"), "doc_id", "rank")
    return R.fuse(a.unionByName(b))


def _softmax(spark, d):
    e, _ = _vectors(spark, d)
    labels = e.groupBy("label").agg(F.min_by("vec", "id").alias("q"))
    return R.softmax_scores(e.drop("label"), labels)


def _keys(spark, d):
    return K.case_keys(table(spark, d, "contacts"), table(spark, d, "devices"))


def _places(spark, d):
    return K.places_from_events(table(spark, d, "events"))


def _coarse(spark, d):
    """Places with coordinates to whole degrees, of which some belong to several cases."""
    return _places(spark, d).withColumns({"latitude": F.round("latitude", 0), "longitude": F.round(F.col("longitude") / 10, 0)})


QUERIES = {
    "f1_entities": _entities,
    "f1_potential_names": lambda s, d: table(s, d, "messages").select("msg_id", F.explode(T.entities(F.col("text"), "potential_names")).alias("name")).distinct(),
    "f2_suspicious": _suspicious,
    "f3_transcript_keywords": _keywords("media_enhancements", "extracted_text", T.TRANSCRIPT_KEYWORDS),
    "f3_document_keywords": _keywords("documents", "text", T.TRANSCRIPT_KEYWORDS),
    "f8_segmented_messages": _segments,
    "f8_segmented_logs": _segmented_logs,
    "f24_zone": lambda s, d: table(s, d, "call_logs").where("timestamp is not null").select("id", F.date_format(F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), "+05:30"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'").alias("local")).distinct(),
    "f26_inferred_types": _inferred,
    "l4_coordinates": _coordinates,
    "l6_addresses": _addresses,
    "l7_kinds_of_place": _kinds_of_place,
    "l11_centre": lambda s, d: _places(s, d).groupBy("case_id").agg(F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"), F.min("latitude").alias("south"), F.max("latitude").alias("north")),
    "l12_geojson": _geojson,
    "f9_phones": _phones,
    "f12_with_country": _with_country,
    "f14_names": _name_signals,
    "f17_scripts": _scripts,
    "f20_normalised": lambda s, d: _docs(s, d).select("doc_id", F.length(T.normalised(F.col("text"))).alias("chars")),
    "f26_field_types": _field_types,
    "f27_schema": _schema,
    "f32_mask_numbers": lambda s, d: table(s, d, "messages").select("msg_id", T.mask_numbers(F.col("text")).alias("text")).where("text like '%[%'").distinct(),
    "f34_hashes": _hashes,
    "f31_chunk_calls": _chunked("calls", R.chunk_calls),
    "f31_chunk_messages": _chunked("messages", R.chunk_messages),
    "f31_chunk_contacts": _chunked("contacts", R.chunk_contacts),
    "f31_chunk_media": _chunked("media", R.chunk_media),
    "f31_chunk_places": lambda s, d: R.chunk_places(_places(s, d)).select("doc_id", "data_type"),
    "f39_call_types": lambda s, d: table(s, d, "call_logs").groupBy(F.when(F.lower(F.trim("call_type")).isin("incoming", "outgoing", "missed"), F.lower(F.trim("call_type"))).otherwise("unknown").alias("direction")).agg(F.count("*").alias("n")),
    "f40_json_field": lambda s, d: table(s, d, "call_logs").select("id", F.get_json_object("location", "$.cell").alias("cell")).where("cell is not null").distinct(),
    "e5_name_similarity": _similar,
    "e8_duplicates": _duplicates,
    "e9_greedy_merges": lambda s, d: K.greedy_merges(_duplicates(s, d)),
    "e11_bands": lambda s, d: K.resolution_summary(K.duplicates(table(s, d, "contacts"), 0.5)),
    "x2_shared_entities": lambda s, d: K.shared_entities(_keys(s, d)),
    "x4_case_links": lambda s, d: K.case_links(_keys(s, d), 0.2),
    "x6_link_statistics": lambda s, d: K.shared_entities(_keys(s, d)).groupBy("match_type").agg(F.count("*").alias("n"), F.max("cases").alias("most_cases")),
    "x8_connections": lambda s, d: K.connections(_keys(s, d)),
    "p_cross_case_timeline": _timeline_parts,
    "v7_linked_cases": lambda s, d: K.linked_cases(_keys(s, d), "CS-00000000", 0.05),
    "g21_case_network": lambda s, d: K.case_network(from_messages_and_calls(table(s, d, "messages"), table(s, d, "calls")), ["CS-00000000", "CS-00000001"]),
    "x4_case_links_all": lambda s, d: K.case_links(_keys(s, d), 0.0),
    "l3_movement": lambda s, d: K.movement(_places(s, d)),
    "l8_visits": lambda s, d: K.visits(_places(s, d)).groupBy("case_id", "kind").agg(F.count("*").alias("n"), F.sum("visits").alias("visits")),
    "l9_clusters": lambda s, d: K.clusters(_places(s, d), 5000.0),
    "l10_shared_places": lambda s, d: K.shared_places(_coarse(s, d)),
    "j8_near_places": lambda s, d: K.near_pairs(_places(s, d), 50.0).groupBy("case_id").agg(F.count("*").alias("pairs")),
    "r2_vector_search": _vector,
    "r3_search_cases": _case_vectors,
    "r7_hybrid": _hybrid,
    "r12_index": _indexed,
    "r2_vector_filtered": _vector_filtered,
    "r5_bm25": _bm25,
    "r6_fused": _fused,
    "r16_softmax": _softmax,
}

_STOP = "(" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + ")"
_BM25 = f"""with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in {_STOP}) as t from documents),
q(query_id, term) as (select query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in {_STOP}))) from (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(_QUERIES))}) v(query_id, query)),
s as (select count(*) as n, avg(len(t)) as avgdl from t),
p as (select term, doc_id, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from t) group by 1, 2),
df as (select term, count(*) as df from p group by 1),
sc as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from p join df using (term) join q using (term), s group by 1, 2),
r as (select cast(query_id as bigint) as query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from sc where score > 0)
"""
_DIG = "regexp_replace(phone_raw, '[^0-9]', '', 'g')"
_K = "regexp_replace(phone_raw, '[^0-9+]', '', 'g')"
_PLACES = """with p as (select event_id as id, 'C' || (user_id % 4) as case_id, user_id as who, round(value % 90, 5) as latitude, round(cast(user_id % 180 as double), 5) as longitude, ts as t from events)
"""
_HAV = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"
_KEYS = """with k as (select distinct * from (select case_id, 'phone' as match_type, phone_digits as key from contacts union all select case_id, 'email', lower(trim(email, ' ')) from contacts
 union all select case_id, 'name', lower(trim(name, ' ')) from contacts union all select case_id, 'device', serial_number from devices) where length(key) > 0 and (match_type <> 'name' or length(key) > 5))
"""
_LINKS = _KEYS + """, per as (select a.case_id as case_a, b.case_id as case_b, a.match_type, count(*) as n from k a join k b on a.match_type = b.match_type and a.key = b.key and a.case_id < b.case_id group by 1, 2, 3),
l as (select case_a, case_b, case when count(*) > 1 then 'multiple_shared_entities' else 'shared_' || min(match_type) end as link_type, cast(sum(n) as bigint) as shared,
 round(least(sum(n * case match_type when 'phone' then 0.4 when 'email' then 0.3 when 'device' then 0.5 else 0.1 * 0.75 end) / 1.5, 1.0), 6) as strength from per group by 1, 2)
"""

_KIND = r"""case when regexp_matches(trim(value, ' '), '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') then 'uuid' when regexp_matches(trim(value, ' '), '^\+?[0-9]{7,15}$') then 'phone'
 when regexp_matches(trim(value, ' '), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}$') then 'email'
 when regexp_matches(trim(value, ' '), '^([0-9]{4}-[0-9]{2}-[0-9]{2}(T|[ \t\n]+)|[0-9]{2}/[0-9]{2}/[0-9]{4}[ \t\n]+)[0-9]{2}:[0-9]{2}:[0-9]{2}') then 'datetime' else 'text' end"""
_ID = "coalesce(case_id, '') || '_{}_' || {} as doc_id"


def _all(pattern: str) -> str:
    return "regexp_extract_all(text, '(?i)" + pattern.replace("'", "''") + "')"


def _keyword_sql(name: str, column: str) -> str:
    return f"select keyword, count(*) as n from {name}, (values " + ", ".join(f"('{k}')" for k in T.TRANSCRIPT_KEYWORDS) + f") v(keyword) where contains(lower({column}), keyword) group by 1"


def _p(before: str, c: str) -> str:
    return f"case when length(cast({c} as varchar)) > 0 then '{before}' || cast({c} as varchar) else '' end"


def _meta(**values: str) -> str:
    return "cast(json_object(" + ", ".join(f"'{k}', coalesce(cast({v} as varchar), '')" for k, v in sorted(values.items())) + ") as varchar) as metadata"


SQL = {
    "f1_entities": "with m as (select distinct msg_id, text from messages), e as (" + " union all ".join(
        f"select msg_id, '{k}' as kind, unnest(list_distinct({' || '.join(_all(p) for p in ps)})) as value from m" for k, ps in T.ENTITY_PATTERNS.items())
    + """) select kind, count(*) as n, count(distinct value) as "values", min(value) as least from e group by 1""",
    "f2_suspicious": f"""with m as (select distinct msg_id, text, sender_raw from messages),
p as (select msg_id, 'cryptocurrency' as pattern_type, 'Crypto Address Detected' as pattern_name, 'high' as severity, 0.9::double as confidence from m where regexp_matches(text, '{T.WALLET}')
 union select msg_id, 'suspicious_content', 'Keyword: ' || k, 'medium', 0.7 from m, (values {", ".join(f"('{k}')" for k in T.KEYWORDS)}) v(k) where contains(lower(text), k)
 union select msg_id, 'foreign_contact', 'International Communication', 'low', 0.8 from m where sender_raw not like '+91%' and regexp_matches(sender_raw, '^\\+[0-9]{{1,3}}[0-9\\s-]+'))
select pattern_type, pattern_name, severity, confidence, count(*) as n from p group by 1, 2, 3, 4""",
    "f3_transcript_keywords": _keyword_sql("media_enhancements", "extracted_text"),
    "f3_document_keywords": _keyword_sql("documents", "text"),
    "f24_zone": """select distinct id, strftime("timestamp" + interval 330 minute, '%Y-%m-%dT%H:%M:%S+05:30') as local from call_logs where "timestamp" is not null""",
    "f26_inferred_types": f"""with p as (select unnest(['contact_id', 'name', 'phone_raw', 'phone_digits', 'email']) as field, unnest([contact_id, name, phone_raw, phone_digits, email]) as value from contacts),
k as (select field, {_KIND} as kind, count(*) as n from p where value is not null group by 1, 2)
select field, arg_max(kind, (n, kind)) as kind, round(max(n) / sum(n), 6) as share from k group by 1""",
    "f26_field_types": f"""with p as (select unnest(['contact_id', 'name', 'phone_raw', 'email']) as field, unnest([contact_id, name, phone_raw, email]) as value from contacts)
select field, case when value is null then 'unknown' else {_KIND} end as kind, count(*) as n from p group by 1, 2""",
    "l11_centre": _PLACES + "select case_id, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude, min(latitude) as south, max(latitude) as north from p group by 1",
    "l7_kinds_of_place": "select distinct media_id, case " + " ".join(f"when regexp_matches(lower(caption), '{'|'.join(w)}') then '{k}'" for k, w in PL.PLACE_WORDS.items()) + " else 'poi' end as kind from media",
    "f32_mask_numbers": """with m as (select msg_id, regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b', '[CARD]', 'g'), '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b', '[ID]', 'g'), '\\b\\d{10}\\b', '[PHONE]', 'g') as text from messages)
select distinct msg_id, text from m where text like '%[%'""",
    "x6_link_statistics": _KEYS + "select match_type, count(*) as n, max(cases) as most_cases from (select match_type, key, count(distinct case_id) as cases from k group by 1, 2) where cases > 1 group by 1",
    "x8_connections": _KEYS + """select a.case_id as case_a, b.case_id as case_b, count(*) as shared, min(a.match_type || ':' || a.key) as first_key, round(least(1.0, count(*) * 0.2), 6) as strength
 from k a join k b on a.match_type = b.match_type and a.key = b.key and a.case_id < b.case_id group by 1, 2""",
    "v7_linked_cases": _LINKS + "select case when case_a = 'CS-00000000' then case_b else case_a end as case_id, link_type, strength from l where strength >= 0.05 and 'CS-00000000' in (case_a, case_b)",
    "g21_case_network": """with c as (select case_id, sender_digits as src, receiver_digits as dst, 'message' as type from messages union all select case_id, caller_digits, receiver_digits, 'call' from calls)
select distinct case_id, src, dst, type from c where case_id in ('CS-00000000', 'CS-00000001') and length(src) > 0 and length(dst) > 0""",
    "r12_index": """select case_id, data_type, count(*) as n from (select distinct case_id, 'message' as data_type, msg_id as id from messages union all select distinct case_id, 'contact', contact_id from contacts
 union all select distinct case_id, 'call', call_id from calls union all select distinct case_id, 'media', media_id from media union all select 'C' || (user_id % 4), 'location', cast(event_id as varchar) from events where value is not null and user_id is not null) group by 1, 2""",
    "r3_search_cases": """with s as (select q.vec_id as query_id, v.vec_id as id, list_dot_product(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.label in (1, 2, 5)),
r as (select *, cast(row_number() over (partition by query_id order by s desc, id) as int) as rank from s) select query_id, id, round(1 - s, 6) as distance, rank from r where rank <= 5 and round(1 - s, 6) <= 1.2""",
    "f31_chunk_places": _PLACES + "select case_id || '_loc_' || id as doc_id, 'location' as data_type from p where latitude is not null and longitude is not null",
    "f9_phones": f"""select distinct contact_id, {_DIG} as digits, case when length({_K}) = 0 then null when {_K} like '+%' then {_K} when {_K} like '00%' then '+' || substr({_K}, 3)
 when {_K} like '0%' and length({_K}) = 11 then '+91' || substr({_K}, 2) when length({_K}) = 10 then '+91' || {_K} when length({_K}) > 10 then '+' || {_K} else '+91' || {_K} end as e164,
 case when length({_DIG}) >= 4 then right({_DIG}, 4) else '' end as suffix from contacts""",
    "f12_with_country": """with c as (select call_id, caller_raw, regexp_replace(caller_raw, '[^0-9]', '', 'g') as g from calls)
select distinct call_id, nullif(case when regexp_matches(caller_raw, '^[^0-9+]*\\+') then g when g like '00%' then substr(g, 3) when length(g) = 11 and g like '0%' then '91' || substr(g, 2) when length(g) = 10 then '91' || g else g end, '') as number from c""",
    "f27_schema": """with p as (select unnest(['contact_id', 'name', 'phone_raw', 'email']) as field, unnest([contact_id, name, phone_raw, email]) as value from contacts)
select field, round(avg(case when value is null then 0.0 else 1.0 end), 6) as present, avg(case when value is null then 0.0 else 1.0 end) >= 0.9 as required, min(length(value)) as shortest, max(length(value)) as longest from p group by 1""",
    "f34_hashes": "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents where text is not null",
    "f31_chunk_calls": f"""with c as (select *, case when duration_seconds >= 60 then (duration_seconds // 60) || 'm ' || (duration_seconds % 60) || 's' when duration_seconds > 0 then duration_seconds || 's' end as took from calls)
select distinct {_ID.format("call", "call_id")}, case when length(direction) > 0 then upper(direction[1]) || lower(direction[2:]) else 'Call' end || ' call from ' || coalesce(caller_raw, caller_digits, 'Unknown') || ' to ' || coalesce(receiver_raw, receiver_digits, 'Unknown')
 || {_p(' | Duration: ', 'took')} || {_p(' | ', '"timestamp"')} as document,
 {_meta(caller="coalesce(caller_raw, caller_digits)", case_id="case_id", data_type="'call'", direction="direction", duration="nullif(duration_seconds, 0)", receiver="coalesce(receiver_raw, receiver_digits)", timestamp='"timestamp"')} from c""",
    "f31_chunk_messages": f"""select distinct {_ID.format("msg", "msg_id")}, '[' || coalesce(app, 'Unknown') || '] Message from ' || coalesce(sender_raw, sender_digits, 'Unknown') || ' to ' || coalesce(receiver_raw, receiver_digits, 'Unknown') || {_p(' at ', '"timestamp"')} || {_p(': ', 'text')} as document,
 {_meta(app="app", case_id="case_id", data_type="'message'", direction="''", receiver="coalesce(receiver_raw, receiver_digits)", sender="coalesce(sender_raw, sender_digits)", timestamp='"timestamp"')} from messages""",
    "f31_chunk_contacts": f"""with c as (select *, coalesce(nullif(phone_raw, ''), phone_digits) as phone from contacts)
select distinct {_ID.format("contact", "contact_id")}, 'Contact: ' || coalesce(name, 'Unknown') || {_p(' | Phone: ', 'phone')} || {_p(' | Email: ', 'email')} as document,
 {_meta(case_id="case_id", data_type="'contact'", email="email", name="name", phone="phone")} from c""",
    "f31_chunk_media": f"""select distinct {_ID.format("media", "media_id")}, 'Media file: ' || coalesce(filename, 'Unknown') || {_p(' | Type: ', 'media_type')} || {_p(' | Size: ', 'nullif(file_size, 0)')} || {_p(' | ', '"timestamp"')} || {_p(' | Caption: ', 'caption')} as document,
 {_meta(case_id="case_id", data_type="'media'", filename="filename", media_type="media_type", timestamp='"timestamp"')} from media""",
    "f39_call_types": "select case when lower(trim(call_type, ' ')) in ('incoming', 'outgoing', 'missed') then lower(trim(call_type, ' ')) else 'unknown' end as direction, count(*) as n from call_logs group by 1",
    "f40_json_field": "select distinct id, json_extract_string(location, '$.cell') as cell from call_logs where json_extract_string(location, '$.cell') is not null",
    "x2_shared_entities": _KEYS + "select substr(md5(match_type || ':' || key), 1, 16) as entity_id, match_type, key, count(distinct case_id) as cases, case when match_type = 'name' then 0.75 else 1.0 end::double as confidence from k group by 2, 3 having count(distinct case_id) > 1",
    "x4_case_links": _LINKS + "select * from l where strength >= 0.2",
    "x4_case_links_all": _LINKS + "select * from l",
    "l3_movement": _PLACES + f""", g as (select *, lag(latitude) over w as la, lag(longitude) over w as lo, lag(t) over w as before_t from p window w as (partition by who order by t, id)),
s as (select *, {_HAV.format(a="la", b="lo", c="latitude", d="longitude")} / 1000 as km, (epoch_us(t) - epoch_us(before_t)) / 3.6e9 as hours from g)
select who, count(*) as points, round(sum(km), 4) as km, round(avg(case when hours > 0 then km / hours end), 4) as mean_speed, round(max(case when hours > 0 then km / hours end), 4) as top_speed,
 round((max(epoch_us(t)) - min(epoch_us(t))) / 8.64e10, 6) as days from s group by 1 having count(*) > 1""",
    "l8_visits": _PLACES + """, v as (select case_id, latitude, longitude, count(*) as visits from p group by 1, 2, 3)
select case_id, case when visits >= 10 then 'frequent' when visits >= 5 then 'regular' else 'poi' end as kind, count(*) as n, cast(sum(visits) as bigint) as visits from v group by 1, 2""",
    "l10_shared_places": _PLACES.replace("round(value % 90, 5)", "round(round(value % 90, 5), 0)").replace("round(cast(user_id % 180 as double), 5)", "round(cast(user_id % 180 as double) / 10, 0)") + "select latitude, longitude, count(distinct case_id) as cases, count(*) as visits, 0.95::double as confidence from p group by 1, 2 having count(distinct case_id) > 1",
    "j8_near_places": _PLACES + f"select a.case_id, count(*) as pairs from p a join p b on a.case_id = b.case_id and a.id < b.id and {_HAV.format(a='a.latitude', b='a.longitude', c='b.latitude', d='b.longitude')} <= 50.0 group by 1",
    "r2_vector_search": """with s as (select q.vec_id as query_id, v.vec_id as id, list_dot_product(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by s desc, id) as int) as rank from s) select query_id, id, round(1 - s, 6) as distance, rank from r where rank <= 5""",
    "r2_vector_filtered": """with s as (select q.vec_id as query_id, v.vec_id as id, list_dot_product(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.label = 3),
r as (select *, cast(row_number() over (partition by query_id order by s desc, id) as int) as rank from s) select query_id, id, round(1 - s, 6) as distance, rank from r where rank <= 5 and round(1 - s, 6) <= 1.0""",
    "r5_bm25": _BM25 + "select * from r where rank <= 10",
    "r6_fused": _BM25 + """, l as (select case when query_id = 0 then 'a' else 'b' end as list_id, doc_id, rank from r where rank <= 10 and query_id in (0, 1))
select doc_id, round(sum(1.0 / (60 + rank)), 6) as score, count(*) as lists, min(list_id) as first_list from l group by 1""",
}
