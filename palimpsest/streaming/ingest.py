"""Incremental ingest: files of frames or typed events become chunks of the index, batch by batch.

The stream's checkpoint holds the offsets; a batch is written whole under its number, so a batch that is
replayed after a failure overwrites itself. Each run takes what is there and ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.embedding import Embedder
from ..functions.text import MIN_TEXT, remap_layout, strip
from ..operators.attribution import attribute, with_frame_context
from ..operators.blocks import chunks_of, session_blocks, shared_blocks, shared_chunks, usable_text
from ..operators.dedup import first_occurrence, not_seen
from ..operators.index import Index
from ..operators.scratch import released, written
from ..schema import schema
from ..sources.capture import new_frames, new_typed
from ..sources.sqlite import read_sqlite, stream_sqlite

FRAMES = schema("id long, timestamp string, app_name string, window_name string, browser_url string, content_hash long, accessibility_text string, ocr string, stream_key long")
TYPED = schema("id long, timestamp string, event_type string, text_content string, app string, window string, url string, stream_key long")


def screen_chunks(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Frames in chunks: hashes first (also of frames without text), then texts, then blocks. ``seen``: content hashes that are known."""
    fresh = first_occurrence(not_seen(rows, seen, "content_hash"), order=("id", "ocr"))
    texts = fresh.withColumn("text", usable_text(F.col("accessibility_text"), F.col("ocr"))).where("text IS NOT NULL")
    named = texts.withColumnsRenamed({"app_name": "app", "window_name": "window", "browser_url": "url"})
    return chunks_of(session_blocks(named, distinct=True), "screen")


def shared_screen_chunks(rows: DataFrame, texts: DataFrame, seen: DataFrame) -> DataFrame:
    """``screen_chunks`` of frames with keys of their texts: key and length, ocr_key, ocr_length, and ocr_at, which sorts as the recognised texts do.

    ``texts``: (key, text), see ``operators.texts``. Chunks come without their texts. Recognised texts of one frame and length are in
    the order of ``ocr_at``, as they were when the first one was picked.
    """
    fresh = first_occurrence(not_seen(rows, seen, "content_hash"), order=("id", "ocr_at"))
    named = picked(fresh).withColumnsRenamed({"app_name": "app", "window_name": "window", "browser_url": "url"})
    return shared_chunks(shared_blocks(named, distinct=True, at="at"), texts, "screen")


def picked(rows: DataFrame) -> DataFrame:
    """Rows with a usable text: its ``key`` and ``length``, the frame's own before the recognised one's, and ``at``, the place of a recognised one."""
    own = {c: F.coalesce(c, f"ocr_{c}") for c in ("key", "length")}
    return rows.withColumns(own | {"at": F.when(F.col("key").isNull(), F.col("ocr_at"))}).where("key IS NOT NULL")


def typed_chunks(rows: DataFrame, remapped: tuple[str, ...] = ("text", "clipboard")) -> DataFrame:
    """Typed events in chunks; the keyboard repair applies to the event types named."""
    plain = strip("text_content")
    texts = rows.withColumn("text", F.when(F.col("event_type").isin(*remapped), remap_layout(plain)).otherwise(plain))
    usable = texts.where(F.char_length("text") >= MIN_TEXT).withColumn("content_hash", F.lit(None).cast("long"))
    return chunks_of(session_blocks(usable, distinct=True), "typed")


def progress(counts: dict, began: float) -> str:
    """New, skipped and total chunks of a batch, and the rate so far."""
    total = counts["new"] + counts["skipped"]
    return f"{counts['new']} new, {counts['skipped']} skipped of {total} chunks, {total / max(time.time() - began, 1e-3):.1f} chunks/s"


def ingest_database(spark: SparkSession, path: str, index: Index, embedder: Embedder, max_frames: int = 0, typed: bool = True, screen: bool = True, safety_lag: int = 0, partitions: int = 1, say: Callable[[str], None] = print, rewind: int = 0) -> dict:
    """Takes what a recorder's SQLite file holds above the watermarks, and saves the state after each part.

    Frames meet their recognised text, typed events the context of their frame or of the frame nearest in time.
    The newest ``safety_lag`` frames are left for the next run, as they may still be written to. Frames without text are
    noted; with ``rewind`` those among so many frames below the watermark whose text has come since are taken as blocks of
    their own. A run that fails is repeated from the same watermark under the same batch name, and overwrites what it wrote.
    ``last_run`` in the state is the time of the last frame read, ``ended`` that of the run.
    """
    state, began = index.state(), time.time()
    frames, texts, events = (read_sqlite(spark, path, name, partitions) for name in ("frames", "ocr_text", "ui_events"))
    stream = F.lit(0).cast("long").alias("stream_key")
    if screen and rewind:
        with released(spark):
            late_texts(frames, texts, index, embedder, state, rewind, say)
    if screen:
        top = (frames.agg(F.max("id")).first()[0] or 0) - safety_lag
        fresh = new_frames(frames.where(F.col("id") <= top), texts, state["last_frame_id"], max_frames)
        high = fresh.agg(F.max("id")).first()[0]
        if high is not None:
            name = f"frames-{state['last_frame_id']}"
            with released(spark):
                index.write_batch(name, screen_chunks(fresh.select("*", stream), index.among("content", fresh.select("content_hash"), name)), embedder)
            say(f"screen: {progress(index.last, began)}, frames to {high}")
            index.note("waiting", name, without_text(fresh))
            state |= {"last_frame_id": high, "last_run": frames.where(F.col("id") == high).first()["timestamp"]}
            index.save_state(state)
    if typed:
        high = events.where(F.col("id") > state["last_ui_event_id"]).agg(F.max("id")).first()[0]
        if high is not None:
            some = new_typed(events.where(F.col("id") <= high), state["last_ui_event_id"])
            with released(spark):
                placed = attribute(with_frame_context(some, frames), frames).select("*", stream)
                index.write_batch(f"typed-{state['last_ui_event_id']}", typed_chunks(placed), embedder)
            say(f"typed: {progress(index.last, began)}, events to {high}")
            state |= {"last_ui_event_id": high}
            index.save_state(state)
    state |= {"chunks": index.chunks().count(), "runs": state["runs"] + 1, "ended": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    index.save_state(state)
    return state


def without_text(rows: DataFrame) -> DataFrame:
    """Frames none of whose texts is usable."""
    usable = usable_text(F.col("accessibility_text"), F.col("ocr")).isNotNull()
    return rows.groupBy("id").agg(F.max(usable.cast("int")).alias("__usable")).where("__usable = 0").select("id")


def late_texts(frames: DataFrame, texts: DataFrame, index: Index, embedder: Embedder, state: dict, rewind: int, say: Callable[[str], None] = print) -> None:
    """Frames that waited for text and have it now become chunks, once: they had given nothing before, so nothing is doubled."""
    low, high, name = state["last_frame_id"] - rewind, state["last_frame_id"], f"late-{state['runs']}"
    waiting = index.noted("waiting").join(index.noted("late").where(F.col("batch") != name).select("id"), "id", "left_anti").where(F.col("id").between(low + 1, high))
    rows = new_frames(frames.where(F.col("id").between(low + 1, high)), texts, low).join(waiting.select("id").distinct(), "id", "left_semi")
    come = written(rows.where(usable_text(F.col("accessibility_text"), F.col("ocr")).isNotNull()), "late")
    if come.isEmpty():
        return
    index.write_batch(name, screen_chunks(come.select("*", F.lit(0).cast("long").alias("stream_key")), index.among("content", come.select("content_hash"), name)), embedder)
    index.note("late", name, come)
    say(f"late: {index.last['new']} chunks of frames read before their text")


def run_once(spark: SparkSession, source: str, schema: StructType, index: Index, checkpoint: str, kind: str, to_chunks: Callable[[DataFrame, str], DataFrame], embedder: Embedder, files_per_batch: int = 1000) -> StreamingQuery:
    """Takes the files that have come since the last run."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"{kind}-{number}"
        with released(spark):
            index.write_batch(name, to_chunks(batch, name), embedder)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_frames(spark: SparkSession, source: str, index: Index, checkpoint: str, embedder: Embedder, **options) -> StreamingQuery:
    return run_once(spark, source, FRAMES, index, checkpoint, "screen", lambda rows, batch: screen_chunks(rows, index.among("content", rows.select("content_hash"), batch)), embedder, **options)


def ingest_typed(spark: SparkSession, source: str, index: Index, checkpoint: str, embedder: Embedder, **options) -> StreamingQuery:
    return run_once(spark, source, TYPED, index, checkpoint, "typed", lambda rows, _: typed_chunks(rows), embedder, **options)


def stream_database(spark: SparkSession, path: str, index: Index, checkpoint: str, embedder: Embedder, partitions: int = 1) -> list[StreamingQuery]:
    """A recorder's SQLite file as two streams, frames and typed events; their offsets are in the checkpoint. Takes what is there and ends."""
    stream = F.lit(0).cast("long").alias("stream_key")

    def screen(rows: DataFrame, name: str) -> DataFrame:
        fresh = new_frames(rows, read_sqlite(spark, path, "ocr_text", partitions), -1)
        return screen_chunks(fresh.select("*", stream), index.among("content", fresh.select("content_hash"), name))

    def typed(rows: DataFrame, _: str) -> DataFrame:
        frames = read_sqlite(spark, path, "frames", partitions)
        return typed_chunks(attribute(with_frame_context(new_typed(rows, -1), frames), frames).select("*", stream))

    queries = []
    for kind, table, to_chunks in (("screen", "frames", screen), ("typed", "ui_events", typed)):

        def write(batch: DataFrame, number: int, kind: str = kind, to_chunks: Callable = to_chunks) -> None:
            with released(spark):
                index.write_batch(f"{kind}-stream-{number}", to_chunks(batch, f"{kind}-stream-{number}"), embedder)

        query = stream_sqlite(spark, path, table, partitions).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{kind}").trigger(availableNow=True).start()
        query.awaitTermination()
        queries.append(query)
    return queries
