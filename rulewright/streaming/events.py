"""Streams: an idempotent append of scored rows, and event-time windows (an extension, not in the blueprint's inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulewright.sources.resume import append_pending


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose keys are not at path yet; a batch that is replayed adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_pending(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type in tumbling windows; works for a table and, with the watermark, for a stream."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    return source.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed after a gap without events."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    return source.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
