"""Ordered events folded into blocks of one context and bounded length, and blocks cut into chunks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK_LIMIT, MIN_TEXT, chunk_hash, split_text, strip
from .ordered import ROW, ROWS, changes, counted, identified, numbered, repeats
from .scratch import written
from .texts import joined, sequences

CONTEXT = ("app", "window")


def usable_text(preferred: Column, fallback: Column) -> Column:
    """The first stripped text of at least the minimum length; null if neither is."""
    a, b = strip(preferred), strip(fallback)
    return F.when(F.char_length(a) >= MIN_TEXT, a).when(F.char_length(b) >= MIN_TEXT, b)


def islands(rows: DataFrame, stream: str = "stream_key", order: str = "id", size: int = ROWS, text: str = "text", length: str | None = None, distinct: bool = False, at: str | None = None) -> DataFrame:
    """Adds ``island``, counting up where app or window changes; nulls equal nulls. Rows alike in every column are one row.

    With ``distinct`` rows whose text is the previous row's are left out first. ``text`` may be a key of the text, if ``length`` names its length;
    ``at`` orders texts of one order and length.
    """
    whole = written(identified(rows), "rows")
    narrow = numbered(whole, stream, order, text if text in rows.columns else order, CONTEXT, size, length, at)
    found = counted(changes(repeats(narrow, size) if distinct else narrow))
    return whole.dropDuplicates([*ROW]).join(found.select(*ROW, "island"), [*ROW]).drop(*ROW)


# ---- blocks ---------------------------------------------------------------------------------------
#
# A block that begins at row i ends with the first row that brings its text to the limit. With P the running sum of lengths
# and line ends, the next block begins at the first row j with P[j] >= P[i] + limit + 1: a binary search. Within a bucket
# rows point to the next beginning, and pointers are doubled until they reach the bucket's last one.


def _next_starts(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(P, the row at which the next block begins if one begins here); one past the end and one: it is not full yet."""
    sums = np.concatenate([[0], np.cumsum(lengths + 1)])
    return sums, np.searchsorted(sums, sums[:-1] + limit + 1)


def _first_start(sums: np.ndarray, open_length: np.ndarray, limit: int) -> np.ndarray:
    """The row at which the first block begins, by the length of the block that is open before; -1: none is open."""
    return np.where(open_length < 0, 0, np.searchsorted(sums, limit - open_length))


def through(pos: np.ndarray, changed: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What is open after a bucket by what is open before it: (length, where it began), for lengths from -1 to ``limit`` - 1.

    A length of -1: no block is open; a beginning of -1: it is the one that was open before. With a change in the bucket there is one answer for all.
    """
    at = np.flatnonzero(changed)
    first = at[-1] if len(at) else 0
    sums, after = _next_starts(lengths[first:], limit)
    n = len(lengths) - first
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    before = np.array([-1]) if len(at) else np.arange(-1, limit)
    start = _first_start(sums, before, limit)
    inside = start < n
    begun = last[np.minimum(start, n - 1)]
    open_length = np.where(after[begun] > n, sums[n] - sums[begun] - 1, -1)
    passed = np.where(start > n, before + sums[n], -1)
    return np.where(inside, open_length, passed), np.where(inside, pos[first:][begun], -1)


def then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One bucket after another."""
    at = first[0] + 1 if len(second[0]) > 1 else np.zeros(len(first[0]), np.int64)
    length, begun = second[0][at], second[1][at]
    return length, np.where(begun >= 0, begun, first[1])


def begins(changed: np.ndarray, lengths: np.ndarray, open_length: int, limit: int) -> np.ndarray:
    """Whether a block begins at each row of a bucket, by the length of the block that is open before it."""
    n = len(lengths)
    sums, after = _next_starts(lengths, limit)
    edges = np.append(np.flatnonzero(changed), n)
    ends = edges[np.searchsorted(edges, np.arange(n), side="right")] if n else edges[:0]
    jump = np.minimum(after, ends).tolist()
    out = np.zeros(n, bool)
    k = min(int(_first_start(sums, np.array([open_length]), limit)[0]), int(edges[0])) if not (n and changed[0]) else 0
    while k < n:
        out[k] = True
        k = jump[k]
    return out


#: Buckets, or groups of them, that one task composes.
GROUP = 256
_THROUGH = "bucket long, opens array<int>, began array<long>"


def _arrays(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    ordered = table.sort_by("bucket")
    return [(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(ordered["opens"].to_pylist(), ordered["began"].to_pylist(), strict=True)]


def _entries(parts: DataFrame, buckets: int, group: int = GROUP) -> DataFrame:
    """(bucket, open, began): what is open before each bucket. Groups are composed, entered, and taken apart again."""

    def composed(table: pa.Table) -> pa.Table:
        opens, began = reduce(then, _arrays(table))
        return pa.table({"bucket": [table["bucket"][0].as_py() // group], "opens": pa.array([opens.tolist()], pa.list_(pa.int32())), "began": pa.array([began.tolist()], pa.list_(pa.int64()))})

    def apart(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("bucket")
        now = (ordered["open"][0].as_py(), ordered["from"][0].as_py())
        rows = []
        for bucket, one in zip(ordered["bucket"].to_pylist(), _arrays(ordered), strict=True):
            rows.append((bucket, *now))
            at = now[0] + 1 if len(one[0]) > 1 else 0
            now = (int(one[0][at]), int(one[1][at]) if one[1][at] >= 0 else now[1])
        return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("bucket", "open", "began"))})

    of = F.call_function("div", F.col("bucket"), F.lit(group))
    if buckets > group:
        above = written(parts.groupBy(of.alias("__g")).applyInArrow(composed, _THROUGH), "composed")
        entered = _entries(above, -(-buckets // group), group).select(F.col("bucket").alias("__g"), F.col("open"), F.col("began").alias("from"))
    else:
        entered = parts.sparkSession.range(1).select(F.lit(0).cast("long").alias("__g"), F.lit(-1).cast("long").alias("open"), F.lit(-1).cast("long").alias("from"))
    return parts.withColumn("__g", of).join(entered, "__g").groupBy("__g").applyInArrow(apart, "bucket long, open long, began long")


def block_numbers(rows: DataFrame, limit: int, group: int = GROUP) -> DataFrame:
    """Adds ``block``, the ``pos`` of its first row, to rows with ``changed``: buckets first say what passes through them."""
    rows = written(rows, "changes")

    def passing(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        opens, began = through(*(np.asarray(t[c]) for c in ("pos", "changed", "__len")), limit)
        return pa.table({"bucket": t["bucket"].slice(0, 1), "opens": pa.array([opens.tolist()], pa.list_(pa.int32())), "began": pa.array([began.tolist()], pa.list_(pa.int64()))})

    def named(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        pos = np.asarray(t["pos"])
        begun = begins(np.asarray(t["changed"]), np.asarray(t["__len"]), t["open"][0].as_py(), limit)
        block = np.maximum.accumulate(np.where(begun, pos, t["began"][0].as_py()))
        return pa.table({**{c: t[c] for c in ROW}, "pos": t["pos"], "block": pa.array(block)})

    narrow = rows.select("bucket", "pos", "changed", F.col("__len").cast("long").alias("__len"), *ROW)
    parts = written(narrow.groupBy("bucket").applyInArrow(passing, _THROUGH), "through")
    most = parts.agg(F.max("bucket")).first()[0]
    entered = _entries(parts, 0 if most is None else most + 1, group)
    return narrow.join(entered, "bucket").groupBy("bucket").applyInArrow(named, f"{ROW[0]} long, {ROW[1]} long, pos long, block long")


def session_blocks(rows: DataFrame, limit: int = CHUNK_LIMIT, distinct: bool = False, size: int = ROWS, group: int = GROUP) -> DataFrame:
    """Blocks of consecutive rows of one app and window; a block that has reached the limit is closed.

    ``rows``: stream_key, id, timestamp (string), app, window, url, text, content_hash. With ``distinct`` rows whose text is the
    previous row's are left out first. Rows without all of that are one row; of one id the shorter text comes first. Neither
    a stream nor an island nor a block's rows are one task's work, but for the rows of one block, which its limit bounds.
    """
    found = _folded(rows, ["text"], limit, distinct, size, group)
    return found.select(*_ABOUT, F.array_join(F.col("r")["text"], "\n").alias("text"), "src_hashes")


def shared_blocks(rows: DataFrame, limit: int = CHUNK_LIMIT, distinct: bool = False, size: int = ROWS, group: int = GROUP, at: str | None = None) -> DataFrame:
    """``session_blocks`` of rows with ``key`` and ``length`` in place of a text (see ``texts``): blocks have ``keys`` and ``sequence`` in place of theirs.

    ``at`` names a column that orders rows of one id and length. Written, as what is read of their texts meets them again.
    """
    found = _folded(rows, ["key", "length"], limit, distinct, size, group, at)
    return written(sequences(found.select(*_ABOUT, F.col("r")["key"].alias("keys"), "src_hashes")), "blocks")


_ABOUT = ("stream_key", "app", "window", "url", "frame_start", "frame_end", "ts_start", "ts_end", "n_frames")


def _folded(rows: DataFrame, text: list[str], limit: int, distinct: bool, size: int, group: int, at: str | None = None) -> DataFrame:
    """What is known of each block, and ``r``, its rows in order."""
    key = F.col("stream_key").cast("long").alias("stream_key")
    needed = rows.select(key, "id", "timestamp", "app", "window", "url", *text, F.col("content_hash").cast("long").alias("content_hash"), *([at] if at else []))
    whole = written(identified(needed), "rows")
    narrow = numbered(whole, "stream_key", "id", text[0], CONTEXT, size, *text[1:], at=at)
    found = block_numbers(changes(repeats(narrow, size) if distinct else narrow), limit, group)
    met = whole.join(found, [*ROW]).groupBy("block").agg(
        F.first("stream_key").alias("stream_key"), F.sort_array(F.collect_set(F.struct("pos", *needed.columns[1:]))).alias("r")
    )
    first, last = F.element_at("r", 1), F.element_at("r", -1)
    return met.select(
        "stream_key", *(first[c].alias(c) for c in ("app", "window", "url")), first["id"].alias("frame_start"), last["id"].alias("frame_end"),
        first["timestamp"].alias("ts_start"), last["timestamp"].alias("ts_end"), F.size("r").alias("n_frames"),
        F.filter(F.col("r")["content_hash"], lambda h: h.isNotNull()).alias("src_hashes"), "r",
    )


def pieces_of_texts(texts: DataFrame, kind: str, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Texts cut to the limit and hashed: other columns stay, piece_no, text, kind and chunk_hash are added."""
    cut = texts.select("*", F.posexplode(split_text("text", limit)).alias("piece_no", "piece")).drop("text").withColumnRenamed("piece", "text")
    return cut.withColumns({"kind": F.lit(kind), "chunk_hash": chunk_hash(F.lit(kind), F.col("text"))})


def chunks_of(blocks: DataFrame, kind: str, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Blocks cut to the limit and hashed; only a block's first piece carries its source hashes."""
    hashes = F.when(F.col("piece_no") == 0, F.col("src_hashes")).otherwise(F.array().cast("array<bigint>"))
    return pieces_of_texts(blocks, kind, limit).withColumn("src_hashes", hashes)


def shared_chunks(blocks: DataFrame, texts: DataFrame, kind: str, limit: int = CHUNK_LIMIT) -> DataFrame:
    """The chunks of ``shared_blocks`` without their texts, but for the length ``n``: each distinct sequence of texts is cut and hashed once."""
    cut = pieces_of_texts(joined(blocks, texts), kind, limit).withColumn("n", F.char_length("text").cast("long")).drop("text")
    return blocks.drop("keys").join(cut, "sequence").drop("sequence")
