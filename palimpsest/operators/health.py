"""Daily health of the capture: a few aggregates in one pass a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_S = 600


def frame_metrics(frames: DataFrame, now: str) -> DataFrame:
    """(frames_total, frames_24h, frame_age_s, max_id) at the time ``now``."""
    at, ts = F.lit(now).cast("timestamp"), F.col("timestamp").try_cast("timestamp")
    return frames.agg(
        F.count("*").alias("frames_total"),
        F.count_if((ts > at - F.expr("interval 1 day")) & (ts <= at)).alias("frames_24h"),
        F.floor((F.unix_micros(at) - F.unix_micros(F.max(ts))) / 1_000_000).alias("frame_age_s"),
        F.max("id").alias("max_id"),
    )


def text_metrics(ocr: DataFrame, frames: DataFrame, now: str) -> DataFrame:
    """(text_chars_24h): characters of recognised text of the last day."""
    at, ts = F.lit(now).cast("timestamp"), F.col("timestamp").try_cast("timestamp")
    recent = frames.where((ts > at - F.expr("interval 1 day")) & (ts <= at)).select(F.col("id").alias("frame_id"))
    lengths = ocr.select("frame_id", F.char_length("text").cast("long").alias("__n"))  # no text meets the frames
    return lengths.join(recent, "frame_id").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("text_chars_24h"))


def typed_metrics(events: DataFrame, now: str) -> DataFrame:
    """(ui_text_24h, clipboard_24h)."""
    at, ts = F.lit(now).cast("timestamp"), F.col("timestamp").try_cast("timestamp")
    recent = (ts > at - F.expr("interval 1 day")) & (ts <= at)
    return events.agg(F.count_if(recent & (F.col("event_type") == "text")).alias("ui_text_24h"), F.count_if(recent & (F.col("event_type") == "clipboard")).alias("clipboard_24h"))


def snapshot(frames: DataFrame, ocr: DataFrame, events: DataFrame, chunks: DataFrame, now: str, watermark: int = 0, service_up: bool = True, db_mb: int = 0, data_mb: int = 0, disk_free_gb: int = 0) -> DataFrame:
    """One row with all metrics, the status and a line of text. An old newest frame outweighs a stopped service."""
    row = frame_metrics(frames, now).crossJoin(text_metrics(ocr, frames, now)).crossJoin(typed_metrics(events, now)).crossJoin(chunks.agg(F.count("*").alias("rag_chunks")))
    age = F.col("frame_age_s")
    status = F.when(age > STALE_S, "stale").when(age.isNull() | ~F.lit(service_up), "degraded").otherwise("ok")
    said = F.format_string(
        "capture=%s; frame_age=%ss; chunks=%d (watermark=%d, lag=%d frames)",
        F.lit("up" if service_up else "down"), F.coalesce(age.cast("string"), F.lit("NA")), F.col("rag_chunks"), F.lit(watermark), F.col("frames_total") - F.lit(watermark),
    )
    return row.select(
        F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd").alias("date"), status.alias("status"), F.coalesce(age, F.lit(0)).alias("frame_age_s"),
        F.lit(db_mb).alias("db_mb"), F.lit(data_mb).alias("data_mb"), F.lit(disk_free_gb).alias("disk_free_gb"),
        "frames_24h", "frames_total", "text_chars_24h", "ui_text_24h", "clipboard_24h", "rag_chunks", F.lit(watermark).cast("long").alias("rag_watermark"),
        (F.coalesce("max_id", F.lit(0)) - F.lit(watermark)).alias("true_lag"), said.alias("actions"),
    )


def append(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").json(path)
