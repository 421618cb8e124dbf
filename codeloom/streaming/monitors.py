"""Live state, liveness and counters; each function works on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ALIVE_GAP = "6 seconds"  # fixed value: three missed heartbeats of two seconds
LOG_SIZE = 50


def latest_by_source(updates: DataFrame) -> DataFrame:
    """Latest update and number of updates per source; pre-aggregated before the shuffle."""
    return updates.groupBy("source_id").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_at"), F.count("*").alias("updates"))


def live_spans(heartbeats: DataFrame, gap: str = ALIVE_GAP, watermark: str = "10 minutes") -> DataFrame:
    """Spans in which a source kept sending; it counts as dead from ``ended`` on.

    A stream gives a span once the watermark has passed its end; later beats of it are dropped.
    """
    if heartbeats.isStreaming:
        heartbeats = heartbeats.withWatermark("ts", watermark)
    return (heartbeats.groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"))
            .select("source_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats"))


def active_sources(heartbeats: DataFrame, now: Column, timeout_seconds: int = 6) -> DataFrame:
    last = heartbeats.groupBy("source_id").agg(F.max("ts").alias("last_at"))
    return last.withColumn("is_alive", (F.unix_micros(now) - F.unix_micros("last_at")) <= timeout_seconds * 1_000_000)


def live_counters(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("detected"), *[
        F.count_if(F.col("type") == k).alias(n) for k, n in (("file_added", "added"), ("file_updated", "updated"), ("conflict", "conflicts"))])


def last_log(changes: DataFrame, size: int = LOG_SIZE) -> DataFrame:
    """The newest entries; a top-k on tables, run per batch on streams."""
    return changes.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(size)
