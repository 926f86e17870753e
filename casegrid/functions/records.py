"""Kind of a record and its fields: from the names of its fields first, then from its text by patterns.

A record is a text and a map from field names to values (either may be null). Where several fields fit, the first by name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of numbers, addresses, instants and durations; kinds of call.
PHONES = r"(?i)\+91[\s-]?\d{10}|91[\s-]?\d{10}|\b\d{10}\b|\+\d{1,3}[\s-]?\d{6,14}|\(\d{3}\)[\s-]?\d{3}[\s-]?\d{4}"
EMAILS = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TIMESTAMPS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}|\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}"
DURATION = r"(?i)(\d+)\s*(seconds?|secs?|minutes?|mins?|hours?|hrs?)"
CALL_TYPES = ["incoming", "outgoing", "missed", "rejected", "blocked", "voicemail"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def phones(text: Column) -> Column:
    """Numbers in a text, without blanks and dashes, in order."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(PHONES), F.lit(0)), lambda p: F.regexp_replace(p, r"[\s-]", ""))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(EMAILS), F.lit(0))


def timestamps(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(TIMESTAMPS), F.lit(0))


def duration(text: Column) -> Column:
    """Seconds of the first duration in a text (`180 seconds`, `3 mins`, `45s`), null if none."""
    n = F.try_to_number(F.nullif(F.regexp_extract(_text(text), DURATION, 1), F.lit("")), F.lit("999999999")).cast("long")
    unit = F.lower(F.regexp_extract(_text(text), DURATION, 2))
    short = F.try_to_number(F.nullif(F.regexp_extract(_text(text), r"(?i)\b(\d{1,5})\s*s\b", 1), F.lit("")), F.lit("99999")).cast("long")
    return F.when(n.isNotNull(), n * F.when(F.startswith(unit, F.lit("h")), 3600).when(F.startswith(unit, F.lit("m")), 60).otherwise(1)).otherwise(short)


def number(phone: Column) -> Column:
    """A number without blanks, dashes and brackets, with +91 before ten digits and + before 91 and ten digits."""
    p = F.regexp_replace(phone, r"[\s()-]", "")
    return F.when(F.startswith(p, F.lit("+")), p).when(F.startswith(p, F.lit("91")) & (F.length(p) == 12), F.concat(F.lit("+"), p)).when(F.length(p) == 10, F.concat(F.lit("+91"), p)).otherwise(p)


def classify(text: Column, fields: Column) -> Column:
    """Struct (record_type, confidence): the first rule that fits, from calls over messages to contacts."""
    keys = F.transform(F.coalesce(F.map_keys(fields), F.array().cast("array<string>")), lambda k: F.lower(k))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    p, t, seconds = F.size(phones(text)) > 0, F.size(timestamps(text)) > 0, duration(text).isNotNull()
    contact = p | (F.size(emails(text)) > 0)
    call, said, ends = seconds | has("call_type", "type", "direction"), has("message", "text", "body", "content"), has("sender", "receiver", "from", "to")
    word = F.rlike(F.lower(_text(text)), F.lit("message|text|chat"))
    kind = lambda k, c: F.struct(F.lit(k).alias("record_type"), F.lit(c).alias("confidence"))
    return (
        F.when(call & p & t, kind("call_log", 0.95)).when(call & p, kind("call_log", 0.85)).when(said & ends & t, kind("message", 0.95)).when(said & ends, kind("message", 0.85))
        .when(t & p & word, kind("message", 0.75)).when(has("name", "contact_name", "display_name") & contact & ~t & ~seconds, kind("contact", 0.9)).when(contact & ~t, kind("contact", 0.7))
        .otherwise(kind("unknown", 0.5))
    )


def _named(pattern: str, earlier: str | None):
    """Condition on an entry that its key holds a pattern and none of earlier ones."""

    def fits(entry: Column) -> Column:
        key = F.lower(entry["key"])
        return F.rlike(key, F.lit(pattern)) if earlier is None else F.rlike(key, F.lit(pattern)) & ~F.rlike(key, F.lit(earlier))

    return fits


def _routed(fields: Column, rules: list[tuple[str, list[str]]]) -> dict[str, Column]:
    """Values of fields routed by parts of their names: a field goes to the first rule of which a part occurs in its name."""
    entries = F.coalesce(F.map_entries(fields), F.array().cast("array<struct<key:string,value:string>>"))
    out, before = {}, None
    for target, parts in rules:
        pattern, earlier = "|".join(parts), before
        out[target] = F.get(F.array_sort(F.filter(entries, _named(pattern, earlier))), F.lit(0))["value"]
        before = pattern if before is None else f"{before}|{pattern}"
    return out


def contact_fields(text: Column, fields: Column) -> dict[str, Column]:
    """name, phone, email, address, organization of a contact."""
    got = _routed(fields, [("name", ["name"]), ("phone", ["phone"]), ("email", ["email"]), ("address", ["address"]), ("organization", ["company", "organization"])])
    named = F.nullif(F.trim(F.regexp_extract(_text(text), r"(?i)(?:Name|Contact|Display Name):\s*([^\n,]+)", 1)), F.lit(""))
    return got | {"name": F.coalesce(got["name"], named), "phone": F.coalesce(number(got["phone"]), number(F.get(phones(text), F.lit(0)))), "email": F.coalesce(got["email"], F.get(emails(text), F.lit(0)))}


def message_fields(text: Column, fields: Column) -> dict[str, Column]:
    """sender, receiver, message_text, timestamp, message_type of a message."""
    got = _routed(fields, [("sender", ["sender", "from"]), ("receiver", ["receiver", "to"]), ("message_text", ["message", "text", "body"]), ("timestamp", ["timestamp", "date", "time"]), ("message_type", ["type", "app"])])
    p = phones(text)
    second = F.get(p, F.lit(1))
    return got | {"sender": F.coalesce(got["sender"], number(F.get(p, F.lit(0)))), "receiver": F.coalesce(got["receiver"], number(second)), "timestamp": F.coalesce(got["timestamp"], F.get(timestamps(text), F.lit(0)))}


def call_fields(text: Column, fields: Column) -> dict[str, Column]:
    """caller, callee, duration_seconds, call_type, timestamp of a call."""
    got = _routed(fields, [("caller", ["caller", "from"]), ("callee", ["callee", "to", "receiver"]), ("duration_seconds", ["duration"]), ("call_type", ["type", "direction"]), ("timestamp", ["timestamp", "date", "time"])])
    p = phones(text)
    kinds = F.get(F.filter(F.array(*map(F.lit, CALL_TYPES)), lambda k: F.contains(F.lower(_text(text)), k)), F.lit(0))
    return got | {
        "caller": F.coalesce(got["caller"], number(F.get(p, F.lit(0)))), "callee": F.coalesce(got["callee"], number(F.get(p, F.lit(1)))),
        "duration_seconds": F.coalesce(got["duration_seconds"], duration(text).cast("string")), "call_type": F.coalesce(got["call_type"], kinds), "timestamp": F.coalesce(got["timestamp"], F.get(timestamps(text), F.lit(0))),
    }


def segment(rows: DataFrame, text: str = "text", fields: str | None = None) -> DataFrame:
    """Rows with record_type, confidence and a map of the fields of their kind; fields without a value are left out.

    Existing columns of these names are replaced, all others kept; a null text counts as an empty one.
    """
    t, f = F.col(text), F.col(fields) if fields else F.lit(None).cast("map<string,string>")
    as_map = lambda d: F.map_filter(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    kept = [c for c in rows.columns if c not in ("record_type", "confidence", "record_fields")]
    kind = F.col("__k.record_type")
    found = F.when(kind == "contact", as_map(contact_fields(t, f))).when(kind == "message", as_map(message_fields(t, f))).when(kind == "call_log", as_map(call_fields(t, f))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("__k", classify(t, f)).select(*kept, "__k.*", found.alias("record_fields"))
