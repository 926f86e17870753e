"""Writers: JSON lines and arrays, partitioned tables, upserts, exports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.lookups import new_rows, upsert_last
from casegrid.session import cut


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines; characters of all scripts as they are."""
    df.write.mode(mode).json(path)


def write_batches(df: DataFrame, path: str, rows: int = 1000) -> None:
    """JSON files of at most `rows` records each."""
    df.write.mode("append").option("maxRecordsPerFile", rows).json(path)


def write_table(df: DataFrame, path: str, by: str = "case_id") -> None:
    """Parquet partitioned by a column. Rows of one value are spread over tasks, so that a large case is written by many."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(by, salt).write.mode("append").partitionBy(by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, as Spark's own file systems see it (file:, hdfs:, object stores)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path and all below it; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """One small text file, through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def append_new(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], by: str = "case_id") -> dict[str, int]:
    """Append the rows of a batch whose key isn't stored yet; counts of inserted and skipped rows."""
    total = batch.count()
    stored = spark.read.parquet(path).select(*keys) if exists(spark, path) else batch.where("false")
    fresh = cut(new_rows(batch, stored, keys))
    n = fresh.count()
    write_table(fresh, path, by)
    return {"inserted": n, "skipped": total - n}


def upsert(spark: SparkSession, batch: DataFrame, path: str, key: str, order: str, by: str = "case_id") -> None:
    """The last version of each key in the touched partitions, rewritten with dynamic overwrite; others stay untouched."""
    touched = batch.select(by).distinct()
    old = spark.read.parquet(path).join(touched, by, "left_semi") if exists(spark, path) else batch.where("false")
    rows = cut(upsert_last(old.unionByName(batch), key, [order]).select(*batch.columns))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """A result as CSV with a header, or as JSON lines."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.json(path)


def unpivoted(df: DataFrame, category: str) -> DataFrame:
    """One row of measures as (Category, Metric, Value)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(c).cast("string").alias("Value")) for c in df.columns])).alias("p")).select(F.lit(category).alias("Category"), "p.*")


def manifest(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Row counts of tables, written as JSON."""
    counts = {k: v.count() for k, v in sorted(tables.items())}
    if tables:
        write_text(next(iter(tables.values())).sparkSession, path, json.dumps({"counts": counts, "total": sum(counts.values())}, indent=1))
    return counts


def investigation_report(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Every table as CSV under its name in a folder, and index.json with their row counts."""
    for name, df in tables.items():
        export(df, f"{folder}/{name}")
    return manifest(tables, f"{folder}/index.json")


def delete_case(spark: SparkSession, path: str, case_id: str) -> bool:
    """Drop the partition of a case from a table partitioned by case_id; whether there was one."""
    from urllib.parse import quote

    return delete(spark, f"{path}/case_id={quote(case_id, safe='-_ ')}")
