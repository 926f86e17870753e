"""Lookups over the case tables: filters, joins with contacts, top-k reads, named graph patterns, summaries of media.

Searches by substring ignore case as the stored tables' own LIKE does; `contains` in named patterns doesn't. Null columns never match.
A limit is part of a lookup where it is named in its signature; ties are broken by the table's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.phones import digits
from casegrid.session import with_scalars



def like(c: str | Column, text: str) -> Column:
    """Substring search without regard to case; wildcards in the text count as themselves."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(c) if isinstance(c, str) else c).ilike(f"%{safe}%")


def newest(rows: DataFrame, facts: DataFrame, limit: int, key: str = "msg_id") -> DataFrame:
    """The `limit` newest rows by the instant that their `timestamp` denotes (column device_id needed), ties by key; rows without one come last.

    facts: zone and system of each device, as operators.timestamps.device_facts gives them. A record delivered twice counts once.
    """
    from casegrid.operators.timestamps import with_instant

    one = with_instant(rows, facts).dropDuplicates([key])
    return one.orderBy(F.desc_nulls_last("utc_ms"), key).limit(limit)


def of_case(rows: DataFrame, case_id: str | None) -> DataFrame:
    return rows if case_id is None else rows.where(F.col("case_id") == case_id)


def by_suffix(messages: DataFrame, suffix: str, case_id: str | None = None) -> DataFrame:
    """Messages of a case, or of all, whose sender's digits end in a suffix of any length."""
    return of_case(messages, case_id).where(F.right("sender_digits", F.lit(len(suffix))) == suffix)


def by_prefix(messages: DataFrame, prefix: str, case_id: str | None = None) -> DataFrame:
    """Messages of a case, or of all, whose sender's digits begin with a prefix."""
    return of_case(messages, case_id).where(F.col("sender_digits").startswith(prefix))


def text_search(messages: DataFrame, text: str, case_id: str | None = None) -> DataFrame:
    """Messages of a case, or of all, whose text holds a text, whatever the case of letters."""
    return of_case(messages, case_id).where(like("text", text))


def call_summary(calls: DataFrame) -> DataFrame:
    """Per case: calls, total, mean and longest duration."""
    return calls.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("total"), F.round(F.avg("duration_seconds"), 6).alias("mean"), F.max("duration_seconds").alias("longest"))


def find_contacts(contacts: DataFrame, case_ids: list[str], name: str | None = None, phone: str | None = None, limit: int = 100) -> DataFrame:
    """Contacts of cases by parts of name and number; without either, nothing."""
    if not name and not phone:
        return contacts.where("false").select("contact_id", F.lit("").alias("document"))
    rows = contacts.where(F.col("case_id").isin(case_ids))
    rows = rows.where(like("name", name)) if name else rows
    rows = rows.where(like("phone_digits", phone)) if phone else rows
    text = F.concat(F.lit("Contact: "), F.coalesce("name", F.lit("Unknown")), F.lit(", Phone: "), F.coalesce("phone_raw", F.lit("N/A")))
    return rows.select("contact_id", text.alias("document")).distinct().orderBy("contact_id", "document").limit(limit)


def search_messages(messages: DataFrame, case_ids: list[str], keyword: str | None = None, sender: str | None = None) -> DataFrame:
    """Messages of cases by parts of text and sender."""
    rows = messages.where(F.col("case_id").isin(case_ids))
    rows = rows.where(like("text", keyword)) if keyword else rows
    return rows.where(like("sender_digits", sender)) if sender else rows


def endpoints(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """All distinct (case_id, digits) at either end of a message or call."""
    parts = [messages.select("case_id", F.col(c).alias("digits")) for c in ("sender_digits", "receiver_digits")]
    parts += [calls.select("case_id", F.col(c).alias("digits")) for c in ("caller_digits", "receiver_digits")]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.where(F.length("digits") > 0).distinct()


def contact_names(contacts: DataFrame) -> DataFrame:
    """One name per (case_id, digits): that of the least contact_id that has one."""
    rows = contacts.where("length(phone_digits) > 0 and length(trim(name)) > 0")
    return rows.groupBy("case_id", F.col("phone_digits").alias("digits")).agg(F.min_by("name", F.struct("contact_id", "name")).alias("name"))


def ego_targets(messages: DataFrame, calls: DataFrame, contacts: DataFrame, case_id: str, limit: int = 200) -> DataFrame:
    """Numbers of a case with the name to show for each."""
    here = F.col("case_id") == case_id
    rows = endpoints(messages.where(here), calls.where(here)).join(contact_names(contacts.where(here)), ["case_id", "digits"], "left")
    return rows.select("digits", F.coalesce("name", "digits").alias("label")).distinct().orderBy("label", "digits").limit(limit)


def named_ends(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Counts of messages by case and name of the sender, 'Unknown' where none is stored (left join on deduplicated contacts)."""
    names = contact_names(contacts)
    rows = messages.where("length(sender_digits) > 0").groupBy("case_id", F.col("sender_digits").alias("digits")).agg(F.countDistinct("msg_id").alias("n"))
    return rows.join(names, ["case_id", "digits"], "left").groupBy("case_id", F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.sum("n").alias("n"))


def active_contacts(messages: DataFrame, contacts: DataFrame, n: int = 10) -> DataFrame:
    """The n contacts with the most messages sent, by an inner join on digits and case."""
    rows = messages.where("length(sender_digits) > 0").groupBy("case_id", F.col("sender_digits").alias("digits")).agg(F.countDistinct("msg_id").alias("n"))
    return rows.join(contact_names(contacts), ["case_id", "digits"]).orderBy(F.desc("n"), "case_id", "digits").limit(n)


def contact_activity(messages: DataFrame, calls: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every named number with messages sent and received and calls made and answered, 0 where none."""
    def side(df: DataFrame, c: str, key: str, as_: str) -> DataFrame:
        return df.where(F.length(c) > 0).select("case_id", F.col(c).alias("digits"), F.col(key).alias("id"), F.lit(as_).alias("kind"))

    rows = side(messages, "sender_digits", "msg_id", "sent").union(side(messages, "receiver_digits", "msg_id", "received"))
    rows = rows.union(side(calls, "caller_digits", "call_id", "made")).union(side(calls, "receiver_digits", "call_id", "answered"))
    kinds = ["sent", "received", "made", "answered"]
    counts = rows.groupBy("case_id", "digits").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return contact_names(contacts).join(counts, ["case_id", "digits"], "left").fillna(0, kinds)


def enhancement_stats(media: DataFrame) -> DataFrame:
    """Per media type, and in all (null): rows, mean confidence, characters of text."""
    return media.rollup("media_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum(F.length("extracted_text")).alias("chars"))


def confidence_bands(media: DataFrame) -> DataFrame:
    """Per language: rows, those above 0.8, those under 0.5, those without text."""
    lang = F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), F.lit("unknown"))
    return media.groupBy(lang.alias("language")).agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"),
        F.count_if(F.coalesce(F.length(F.trim("extracted_text")), F.lit(0)) == 0).alias("empty"))


def provenance(media: DataFrame) -> DataFrame:
    """Rows that carry all four facts on where they come from, per case."""
    full = F.col("case_id").isNotNull() & F.col("file_path").isNotNull() & F.col("sha256_hash").isNotNull() & F.col("created_at").isNotNull()
    return media.groupBy("case_id").agg(F.count_if(full).alias("full"), F.count("*").alias("n"), F.round(F.try_divide(F.count_if(full), F.count("*")), 6).alias("share"))


def first_by_hash(media: DataFrame, in_case: bool = True) -> DataFrame:
    """One row per content hash, in each case or in all: that of the least media_id."""
    keys = ["case_id", "sha256"] if in_case else ["sha256"]
    return media.where("sha256 is not null").groupBy(*keys).agg(F.min("media_id").alias("media_id"), F.count("*").alias("copies"))


def media_search(media: DataFrame, word: str, media_type: str = "image") -> DataFrame:
    """Media of a type whose scanned text or caption holds a word, and which of both does."""
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
    kind = F.when(hit("ocr_text") & hit("caption"), "both").when(hit("ocr_text"), "ocr").otherwise("caption")
    return media.where((F.lower(F.trim("media_type")) == media_type) & (hit("ocr_text") | hit("caption"))).select("media_id", kind.alias("match_type")).distinct()


def callers_of(calls: DataFrame, contacts: DataFrame, number: str) -> DataFrame:
    """Distinct numbers, with name where stored, that called a number."""
    rows = calls.where((F.col("receiver_digits") == number) & (F.length("caller_digits") > 0)).select("case_id", F.col("caller_digits").alias("digits")).distinct()
    return rows.join(contact_names(contacts), ["case_id", "digits"], "left").select("digits", "name").distinct()


def between_names(messages: DataFrame, contacts: DataFrame, a: str, b: str) -> DataFrame:
    """Messages, in either direction, between numbers stored under two names."""
    names = contact_names(contacts).select("case_id", "digits", F.lower("name").alias("name"))
    s = names.select("case_id", F.col("digits").alias("sender_digits"), F.col("name").alias("s"))
    r = names.select("case_id", F.col("digits").alias("receiver_digits"), F.col("name").alias("r"))
    rows = messages.join(s, ["case_id", "sender_digits"]).join(r, ["case_id", "receiver_digits"])
    hit = (F.contains("s", F.lit(a.lower())) & F.contains("r", F.lit(b.lower()))) | (F.contains("s", F.lit(b.lower())) & F.contains("r", F.lit(a.lower())))
    return rows.where(hit).select("msg_id", "s", "r").distinct()


def frequent_callers(calls: DataFrame, least: int = 10) -> DataFrame:
    rows = calls.where("length(caller_digits) > 0").groupBy("caller_digits").agg(F.countDistinct("call_id").alias("n"))
    return rows.where(F.col("n") > least)


def phone_digits_check(calls: DataFrame) -> DataFrame:
    """How raw numbers relate to their stored digits: rows per kind of number and agreement of the digits' last four."""
    raw = digits(F.col("caller_raw"))
    kind = F.when(F.col("caller_raw").isNull(), "none").when(F.startswith(F.ltrim("caller_raw"), F.lit("+")), "plus").when(F.startswith("caller_raw", F.lit("00")), "00").otherwise("other")
    same = F.coalesce(F.right(raw, F.lit(4)) == F.col("caller_suffix_4"), F.lit(False))
    return calls.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def upsert_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by an order (ties: the greatest of all columns); null keys are dropped."""
    cols = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in cols])


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose full key is neither stored nor repeated in the batch; rows with a null in the key are all new."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    keyed = batch.where(full).dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")
    return keyed.select(*batch.columns).unionByName(batch.where(~full))


def sample_rows(rows: DataFrame, by: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each group, those of the least hash of the key: a uniform sample that is the same every time."""
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), key)
    rows = rows.withColumns({"__h": h, "__s": F.pmod(h, F.lit(64))})
    for keys in ([by, "__s"], [by]):  # first within parts of each group, so that no task sees a whole large one
        w = Window.partitionBy(*keys).orderBy("__h", key)
        rows = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return rows.drop("__r", "__h", "__s")


def latest_days(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last days before the newest row, rather than before now."""
    last = rows.agg(F.max(at).alias("__last"))
    return with_scalars(rows, last).where(F.col(at) >= F.col("__last") - F.make_dt_interval(F.lit(days))).drop("__last")


def search_entities(entities: DataFrame, media: DataFrame, case_id: str, kind: str | None = None, value: str | None = None) -> DataFrame:
    """Entities (id, kind, value) found in enhanced media of a case, with the file they come from, by kind and a part of the value."""
    rows = entities.join(media.select("id", "case_id", "file_path", "media_type").distinct(), "id").where(F.col("case_id") == case_id)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(like("value", value)) if value else rows
    return rows.select("id", "file_path", "media_type", "kind", "value").distinct()


def wallets_in(messages: DataFrame) -> DataFrame:
    """(msg_id, wallet): addresses of wallets that messages refer to."""
    from casegrid.functions.text import entities

    return messages.select("msg_id", F.explode(entities(F.col("text"), "crypto_wallet")).alias("wallet")).distinct()


def case_samples(messages: DataFrame, contacts: DataFrame, calls: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """(case_id, kind, id): of each case 50 contacts, 100 messages and 50 calls, those of the least hash, the same every time."""
    sizes = sizes or {"contact": 50, "message": 100, "call": 50}
    parts = {"contact": contacts.select("case_id", F.col("contact_id").alias("id")), "message": messages.select("case_id", F.col("msg_id").alias("id")), "call": calls.select("case_id", F.col("call_id").alias("id"))}
    out = None
    for kind, rows in parts.items():
        few = sample_rows(rows.where("case_id is not null").distinct(), "case_id", "id", sizes[kind]).select("case_id", F.lit(kind).alias("kind"), "id")
        out = few if out is None else out.unionByName(few)
    return out


# Words by which a cross-case report looks for dealings in crypto currency.
CRYPTO_WORDS = ["bitcoin", "crypto", "wallet", "btc", "eth", "blockchain", "usdt"]


def crypto_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.rlike(F.lower("text"), F.lit("|".join(CRYPTO_WORDS)))).select("case_id", "msg_id").distinct()
