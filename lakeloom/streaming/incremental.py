"""Continuous upkeep: chunks and indexes that follow a stream of documents, and time windows over telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk
from ..plans.segments import Segments


def follow_chunks(docs: DataFrame, target: str, checkpoint: str, style: str = "structured") -> StreamingQuery:
    """Writes the chunks of new documents below target, one folder for each batch; a batch that is repeated overwrites its folder."""

    def add(batch: DataFrame, number: int) -> None:
        chunk(batch, style).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_index(changes: DataFrame, index: Segments, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes (see Segments.apply) to a lexical index; a batch that is repeated changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        index.apply(batch, number)

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, mean and most of a value by event type and time window; events that come too late for the stated delay are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "most")
