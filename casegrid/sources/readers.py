"""Readers of evidence files. Numbers with a leading `+` stay strings: every reader takes or makes a schema of strings.

Errors: a bad JSON document or CSV line gives nulls with the text in `_corrupt_record`; a bad line of a JSON-lines file voids
the read if strict. Empty files give no rows. Archives are opened in the tasks; members with absolute paths or `..` are skipped.
"""

from __future__ import annotations

import io
import sqlite3
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from casegrid.functions.text import key_values


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents, as a column `record` of JSON text: a list's items, or those of an object's first list."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    as_list = F.from_json("doc", "array<string>")
    fields = F.from_json("doc", "map<string,string>")
    first = F.element_at(F.filter(F.map_values(fields), lambda v: F.startswith(F.ltrim(v), F.lit("["))), 1)
    items = F.when(F.startswith(F.ltrim("doc"), F.lit("[")), as_list).otherwise(F.from_json(first, "array<string>"))
    return whole.select(F.explode(items).alias("record"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One record per line; blank lines are skipped. Strict: a bad line voids the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType) -> DataFrame:
    """Rows of an XML tag with a given schema (attributes as `_name`)."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)


def sniff_separator(head: str) -> str:
    """A tab anywhere in the first 1024 characters makes a file tab-separated."""
    return "\t" if "\t" in head[:1024] else ","


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Delimited text with a header line, all columns strings; the separator is sniffed from the first line of one file."""
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        separator = sniff_separator(first[0][0]) if first else ","
    return spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)


def read_key_values(spark: SparkSession, path: str, per_block: bool = True) -> DataFrame:
    """Maps of `Key: value` lines: one per block between blank lines, or one per file."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"\n\s*\n")).alias("value")) if per_block else whole
    return blocks.select(key_values(F.col("value")).alias("record")).where(F.size("record") > 0)


def pipe_tables(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of tables drawn with `|`, as maps from header to cell; a row counts if it has as many cells as the header."""
    cells = lambda c: F.transform(F.split(F.trim(c, F.lit("| ")), r"\|"), lambda x: F.trim(x))
    lines = F.filter(F.split(column, r"\n"), lambda x: F.contains(x, F.lit("|")))
    t = texts.select(lines.alias("l")).where(F.size("l") > 1).select(cells(F.get("l", F.lit(0))).alias("h"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("r"))
    t = t.select("h", cells(F.col("r")).alias("c")).where((F.size("h") == F.size("c")) & ~F.forall("c", lambda x: F.rlike(x, F.lit(r"^[-:\s]*$"))))
    return t.select(F.map_from_arrays("h", "c").alias("record"))


def first_of(columns: list[str], *names: str) -> Column:
    """The first of several columns that exists and isn't empty."""
    own = [F.nullif(F.col(n), F.lit("")) for n in names if n in columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def canonical_messages(rows: DataFrame) -> DataFrame:
    """Messages of any of the known field names under one set of names; missing app and type get defaults."""
    c = rows.columns
    digits = lambda x: F.regexp_replace(x, r"[^0-9]", "")
    sender, receiver = first_of(c, "from_person", "from", "sender", "sender_raw"), first_of(c, "to_person", "to", "receiver", "receiver_raw")
    at = F.try_to_timestamp(F.regexp_replace(first_of(c, "timestamp", "date", "time"), "Z$", "+00:00"))
    return rows.select(
        sender.alias("sender_raw"), digits(sender).alias("sender_digits"), receiver.alias("receiver_raw"), digits(receiver).alias("receiver_digits"),
        first_of(c, "text", "body", "message", "content").alias("text"), F.coalesce(first_of(c, "app", "source"), F.lit("unknown")).alias("app"),
        F.coalesce(first_of(c, "message_type", "type"), F.lit("text")).alias("message_type"), at.alias("timestamp"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Manifest of all files under a folder: path, name, extension, size, time and SHA-256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.select("path", name.alias("filename"), ext.alias("extension"), F.col("length").alias("file_size"), "modificationTime", F.sha2("content", 256).alias("sha256_hash"))


def category(extension: Column) -> Column:
    """Kind of file by its extension."""
    return (
        F.when(extension.isin("jpg", "jpeg", "png", "gif", "bmp", "webp", "heic"), "image").when(extension.isin("mp3", "wav", "ogg", "opus", "m4a", "amr"), "audio")
        .when(extension.isin("mp4", "mov", "avi", "mkv", "3gp"), "video").when(extension.isin("pdf", "doc", "docx"), "document")
        .when(extension.isin("json", "jsonl", "xml", "csv", "tsv", "txt", "log"), "text").when(extension.isin("db", "sqlite", "sqlite3"), "database")
        .when(extension.isin("zip", "tar", "gz", "tgz", "7z"), "archive").otherwise("unknown")
    )


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    safe = lambda n: not n.startswith(("/", "\\")) and ".." not in Path(n).parts
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir() and safe(i.filename):
                    yield i.filename, z.read(i)
    elif name.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile() and safe(m.name):
                    yield m.name, t.extractfile(m).read()


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, sha256_hash, content) of all archives under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"]):
                for member, data in _members(p, bytes(c)):
                    yield pd.DataFrame({"archive": [p], "member": [member], "content": [data]})

    out = raw.mapInPandas(run, "archive string, member string, content binary")
    return out.select("archive", "member", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256_hash"), "content")


def changed_members(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Members whose hash differs from the stored manifest, or that are missing on either side."""
    a = stored.select("member", F.col("sha256_hash").alias("stored_hash"))
    rows = a.join(now.select("member", "sha256_hash"), "member", "full")
    return rows.where(~F.equal_null("stored_hash", "sha256_hash"))


def entropy(content: Column, most: int | None = None) -> Column:
    """Bits per byte of binary content, or of its first `most` bytes; above 7.5 it is likely encrypted or packed."""

    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        import numpy as np

        def one(b) -> float | None:
            if b is None:
                return None
            n = np.bincount(np.frombuffer(bytes(b if most is None else b[:most]), np.uint8), minlength=256)
            p = n[n > 0] / max(1, n.sum())
            return float(-(p * np.log2(p)).sum())

        return s.map(one)

    return of(content)


class SQLiteSource(DataSource):
    """`spark.read.format("casegrid_sqlite")`: one table of an SQLite file, split by rowid. Options: path, table, parts."""

    @classmethod
    def name(cls) -> str:
        return "casegrid_sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = [r[1] for r in db.execute(f'pragma table_info("{self.options["table"]}")')]
        return strings(*columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SQLiteReader(self.options["path"], self.options["table"], int(self.options.get("parts", "4")), schema)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType) -> None:
        self.path, self.table, self.parts, self.columns = path, table, parts, schema.names

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'cast("{c}" as text)' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    """All columns of an SQLite table as strings, read in ranges of rowid."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("casegrid_sqlite").option("table", table).option("parts", str(parts)).load(path)


def common_columns(source: DataFrame, target: list[str], case_id: str) -> DataFrame:
    """The columns a source shares with a target, in the target's order, under one case_id."""
    own = [c for c in target if c in source.columns and c != "case_id"]
    return source.select(*own, F.lit(case_id).alias("case_id"))
