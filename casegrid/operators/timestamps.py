"""Mixed timestamp formats and zones to one instant (problem 4).

The plan makes the shape mask of each string with built-in expressions; a vectorised function then maps each
distinct mask to a parser once per process and converts all strings of the mask together (functions/instants.py),
wall-clock values through the zone transition tables (functions/zones.py).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from casegrid.functions import instants
from casegrid.session import table


@F.pandas_udf(LongType())
def _millis(text: pd.Series, mask: pd.Series, zone: pd.Series, ios: pd.Series) -> pd.Series:
    return instants.to_millis(text, mask, zone, ios)


def trimmed(c: Column) -> Column:
    """All kinds of blanks become one plain space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\h\x{200b}\x{feff}]+", " "))


def utc_millis(text: Column, zone: Column, ios: Column) -> Column:
    """Instant of a timestamp string in milliseconds since 1970 UTC.

    zone: IANA name for wall-clock values (null: UTC). ios: whether plain numbers may count from 2001.
    Null, blank, relative or impossible values give null; a text too long for any format gives null.
    """
    t = trimmed(text)
    t = F.when((F.length(t) >= 8) & (F.length(t) <= 64), t)
    mask = F.regexp_replace(F.regexp_replace(t, "[A-Za-z]", "a"), "[0-9]", "9")
    return _millis(F.coalesce(t, F.lit("")), F.coalesce(mask, F.lit("")), zone, ios)


def device_facts(devices: DataFrame, device_zones: DataFrame) -> DataFrame:
    """One row per device: __zone (null if not known) and __ios. Repeated device rows are folded."""
    os = devices.groupBy("device_id").agg(F.max(F.lower(F.trim("os_type")) == "ios").alias("__ios"))
    zone = device_zones.groupBy("device_id").agg(F.min(F.trim("zone_name")).alias("__zone"))
    return os.join(zone, "device_id", "full").where(F.col("device_id").isNotNull())


def with_instant(rows: DataFrame, facts: DataFrame, column: str = "timestamp", name: str = "utc_ms") -> DataFrame:
    """Add the instant of a timestamp column; rows are kept as they are, whether or not their device is known.

    Existing columns called like the added one are replaced; `rows` needs `device_id` and the timestamp column.
    """
    kept = [c for c in rows.columns if c != name]
    joined = rows.join(facts, "device_id", "left")
    found = utc_millis(F.col(column), F.col("__zone"), F.coalesce("__ios", F.lit(False)))
    return joined.withColumn("__ms", found).select(*kept, F.col("__ms").alias(name))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source_table, record_id, timestamp, utc_ms) of messages, calls and media, nulls included."""
    parts = [
        table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), "device_id", "timestamp")
        for name, key in (("messages", "msg_id"), ("calls", "call_id"), ("media", "media_id"))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    facts = device_facts(table(spark, sf_dir, "devices"), table(spark, sf_dir, "device_zones"))
    return with_instant(rows, facts).select("source_table", "record_id", "timestamp", "utc_ms")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that denotes an instant and is not already written as YYYY-MM-DDTHH:MM:SSZ."""
    plain = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
    found = normalised(spark, sf_dir).where(F.col("utc_ms").isNotNull() & ~F.coalesce(F.col("timestamp").rlike(plain), F.lit(False)))
    return found.select("source_table", "record_id", "utc_ms").distinct()
