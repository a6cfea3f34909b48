"""Structured Streaming forms (extensions; the reference has no streaming of its own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from orefield.operators.snapshots import digest_bytes


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and event type with a watermark; events later than ``late`` are dropped
    by append mode, which is the feature's bound on state."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    span = F.window("at", window, slide) if slide else F.window("at", window)
    counted = timed.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events with no pause longer than ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def unseen_content(files: DataFrame, late: str = "7 days") -> DataFrame:
    """Captures whose content digest hasn't been seen for the file within the watermark."""
    keyed = files.withColumn("at", F.col("captured_at").cast("timestamp")).withColumn("digest", F.sha2("content", 256))
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["repository", "file", "digest"])


def apply_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch operator (a scan's reconciliation, say) on every micro-batch, once each."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_digests(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Symbols of a micro-batch whose digest differs from the known one or that are new."""
    a = batch.select("repository", "id", digest_bytes(F.col("content_hash")).alias("hash"))
    b = known.select("repository", "id", digest_bytes(F.col("content_hash")).alias("hash"))
    return a.join(b, ["repository", "id", "hash"], "left_anti")
