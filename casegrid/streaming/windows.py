"""Communications as streams: counts per window, sessions, deduplication, all under a watermark.

The same functions run on batches, where the watermark has no effect. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A folder of JSON-lines files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def window_counts(events: DataFrame, at: str = "timestamp", late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Messages and calls per tumbling or sliding window."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    rows = events.withWatermark(at, late).groupBy(w.alias("w")).agg(F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("type") == "call").alias("calls"))
    return rows.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "messages", "calls")


def sessions(events: DataFrame, key: str = "sender", at: str = "timestamp", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, ended by a gap; the end is the last event plus the gap, as in Spark's session windows."""
    rows = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def distinct_events(events: DataFrame, keys: list[str], at: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and end; the result as a table in memory, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
