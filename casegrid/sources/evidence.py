"""Evidence as a whole: the format of an extraction, artifacts of its XML reports, and the tables of a case under one set of names.

Nothing is guessed from values: numbers stay strings, unreadable times become null, and missing kinds read 'unknown' where a table says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import phones as P
from casegrid.functions.text import seconds_of
from casegrid.sources.readers import _members, first_of

# Names of members by which a format is known, in this order.
FORMATS = {
    "cellebrite_ufed": ["ufed_device_info.xml", "Extraction Files/", "Analytics/"], "cellebrite_pa": ["project.pap", "Extraction Data/", "Analytics Data/"],
    "oxygen": ["oxygen.db", "OxygenForensicSuite", "Plist.xml"], "xry": ["xry_extraction.xml", "XRY Files/", "Device.xry"],
    "msab": ["msab_report.xml", "MSAB Extract/", "extraction.msab"], "axiom": ["axiom_case.xml", "Artifacts/", "Media/"],
}
#: Field names under which the fields of each table come, the first that holds a value counts.
ALIASES = {
    "contacts": {"contact_id": ["contact_id", "id"], "name": ["name", "contact_name", "display_name", "full_name"], "phone_raw": ["phone_raw", "phone", "phone_number", "mobile", "cell"], "email": ["email", "email_address", "e_mail"]},
    "messages": {"msg_id": ["msg_id", "message_id", "id"], "sender_raw": ["from_person", "from", "sender", "sender_raw"], "receiver_raw": ["to_person", "to", "receiver", "receiver_raw", "recipient"], "text": ["text", "body", "message", "content"], "app": ["app", "source"], "message_type": ["message_type", "type"], "timestamp": ["timestamp", "date", "time", "created_at"]},
    "calls": {"call_id": ["call_id", "id"], "caller_raw": ["from_number", "caller", "from", "caller_raw"], "receiver_raw": ["to_number", "callee", "to", "receiver", "receiver_raw"], "duration_seconds": ["duration_seconds", "duration", "call_duration"], "direction": ["direction", "call_type", "type"], "timestamp": ["timestamp", "date", "time", "created_at"]},
    "media": {"media_id": ["media_id", "id"], "filename": ["filename", "file_name", "name"], "media_type": ["media_type", "type"], "sha256": ["sha256", "hash"], "file_size": ["file_size", "size"], "timestamp": ["timestamp", "date", "created_at"]},
    "locations": {"location_id": ["location_id", "id"], "latitude": ["latitude", "lat"], "longitude": ["longitude", "lon", "lng"], "accuracy": ["accuracy"], "timestamp": ["timestamp", "date", "time"]},
    "devices": {"device_id": ["device_id", "id"], "imei": ["imei"], "serial_number": ["serial_number", "serial"], "manufacturer": ["manufacturer", "make"], "model": ["model"], "os_type": ["os_type", "os"], "os_version": ["os_version"], "owner": ["owner"]},
}
DEFAULTS = {"app": "unknown", "message_type": "text", "direction": "unknown", "media_type": "unknown"}
_NUMBERS = {"phone_raw": "phone", "sender_raw": "sender", "receiver_raw": "receiver", "caller_raw": "caller"}


def format_of(members: list[str], head: bytes = b"") -> str:
    """Format by the names of an archive's members, the first that fits; else by the head of a file; 'unknown' if neither tells."""
    found = next((k for k, parts in FORMATS.items() if any(p in m for m in members for p in parts)), None)
    return found or ("generic_xml" if b"<?xml" in head[:1024] else "unknown")


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, members) of every file under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"]):
                names = [n for n, _ in _members(p, bytes(c))]
                rows.append((p, format_of(names, bytes(c[:1024])), len(names)))
            yield pd.DataFrame(rows, columns=["path", "format", "members"])

    return raw.mapInPandas(run, "path string, format string, members int")


def artifact_kind(tag: Column) -> Column:
    """Kind of artifact by its XML tag, the first part that occurs in it: message, call, contact, media, location, device or other."""
    low = F.lower(tag)
    has = lambda *parts: F.rlike(low, F.lit("|".join(parts)))
    return F.when(has("message", "chat", "sms"), "message").when(has("call"), "call").when(has("contact"), "contact").when(has("media", "attachment"), "media").when(has("location", "gps"), "location").when(has("device"), "device").otherwise("other")


def xml_artifacts(documents: DataFrame) -> DataFrame:
    """(path, tag, kind, fields, values) of the artifacts of XML documents (path, content): elements whose own tag names a kind and that hold
    fields, not other artifacts. fields: attributes and children by lower-case name, an attribute first, the first of several children;
    values: all of several children of a name. A document that can't be read gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    root = ET.fromstring(bytes(content))
                except ET.ParseError:
                    continue
                for e in root.iter():
                    children = [c for c in e.iter() if c is not e and (c.text or "").strip() and not len(c)]
                    nested = any(len(c) or c.attrib for c in e)
                    if not e.attrib and (not children or nested):
                        continue
                    fields, values = {}, {}
                    for c in children if not nested else []:
                        fields.setdefault(c.tag.lower(), c.text.strip())
                        values.setdefault(c.tag.lower(), []).append(c.text.strip())
                    fields |= {k.lower(): v for k, v in e.attrib.items() if v}
                    if fields:
                        out.append((path, e.tag, list(fields.items()), list(values.items())))
            yield pd.DataFrame(out, columns=["path", "tag", "fields", "values"])

    rows = documents.select("path", "content").mapInPandas(run, "path string, tag string, fields array<struct<k:string,v:string>>, values array<struct<k:string,v:array<string>>>")
    rows = rows.select("path", "tag", artifact_kind(F.col("tag")).alias("kind"), F.map_from_entries("fields").alias("fields"), F.map_from_entries("values").alias("values"))
    return rows.where("kind <> 'other'")


def columns_of(artifacts: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Artifacts of a kind as a table of strings, one column per field name."""
    return artifacts.where(F.col("kind") == kind).select("path", *[F.col("fields")[n].alias(n) for n in names])


def canonical(rows: DataFrame, name: str, case_id: str) -> DataFrame:
    """Rows of any of the known field names as a table of a case: numbers with digits and suffixes, times as instants (null if unreadable),
    seconds, sizes and coordinates as numbers, defaults for kinds."""
    c = rows.columns
    out = {"case_id": F.lit(case_id)}
    for field, names in ALIASES[name].items():
        v = first_of(c, *names)
        if field in _NUMBERS:
            d = P.digits(v)
            out |= {field: v, f"{_NUMBERS[field]}_digits": d, f"{_NUMBERS[field]}_suffix_2": P.suffix(d, 2), f"{_NUMBERS[field]}_suffix_4": P.suffix(d, 4)}
        elif field == "timestamp":
            out[field] = F.try_to_timestamp(F.regexp_replace(v, "Z$", "+00:00"))
        elif field == "duration_seconds":
            out[field] = seconds_of(v)
        elif field in ("latitude", "longitude", "accuracy"):
            out[field] = v.try_cast("double")
        elif field == "file_size":
            out[field] = v.try_cast("long")
        else:
            out[field] = F.coalesce(v, F.lit(DEFAULTS[field])) if field in DEFAULTS else v
    table = rows.select(*[v.alias(k) for k, v in out.items()])
    if name == "contacts":
        return table.where("length(trim(name)) > 0 or length(phone_raw) > 0")
    return table.where("latitude between -90 and 90 and longitude between -180 and 180") if name == "locations" else table


def read_case(spark: SparkSession, folder: str, case_id: str) -> dict[str, DataFrame]:
    """The tables of a case from a folder of JSON lines, one file (or folder) per table, `.jsonl` before `.json`; tables without one are left out."""
    from casegrid.sources.sinks import exists

    out = {}
    for name, fields in ALIASES.items():
        path = next((p for p in (f"{folder}/{name}.jsonl", f"{folder}/{name}.json") if exists(spark, p)), None)
        if path:
            names = sorted({a for aliases in fields.values() for a in aliases})
            rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("mode", "PERMISSIVE").json(path)
            out[name] = canonical(rows, name, case_id)
    return out
