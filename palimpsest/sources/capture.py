"""The captured tables as frames and typed events: incremental scans with their predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_TEXT

TYPED = ("text", "clipboard")


def new_frames(frames: DataFrame, ocr: DataFrame, watermark: int = 0, max_frames: int = 0) -> DataFrame:
    """Frames above the watermark with their recognised text, several rows where there are several texts.

    A limit counts frames, so that no frame is cut in two.
    """
    fresh = frames.where(F.col("id") > watermark)
    if max_frames > 0:
        fresh = fresh.orderBy("id").limit(max_frames)
    texts = ocr.select(F.col("frame_id").alias("id"), F.col("text").alias("ocr"))
    return fresh.select("id", "timestamp", "app_name", "window_name", "browser_url", "content_hash", "accessibility_text").join(texts, "id", "left")


def new_typed(events: DataFrame, watermark: int = 0) -> DataFrame:
    """Typed and pasted texts above the watermark that are long enough without spaces at their ends."""
    long_enough = F.char_length(F.trim("text_content")) >= MIN_TEXT
    return events.where((F.col("id") > watermark) & F.col("event_type").isin(*TYPED) & F.col("text_content").isNotNull() & long_enough)
