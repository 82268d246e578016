"""Substring dedup: words in passages of 35 words that also start elsewhere.

First pass: every partition counts, in a count-min sketch, the minimizer of each window (the least hash
among its grams of eight words), once per place. A window that occurs twice has its minimizer at
two places, so the merged sketches never count less than a window's own count. Second pass: only windows
whose minimizer is estimated repeated are grouped, exactly, by the hashes of minimizer and window.
Neighbouring windows mostly share a minimizer and travel together, 8 bytes each. Windows of a minimizer that
is estimated frequent travel one by one, dealt by their own hash, so that neither a passage of thousands of
copies nor a stock phrase in many surroundings is one task's work.

Edge cases: a null or empty text has no words and keeps none; a text below 35 words has no window;
a passage repeated within one text, overlapping itself or not, counts; repeated rows are copies of each
other and lose every window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions_for, persist
from .words import hashed, raw, split

WINDOW, GRAM = 35, 8
#: Cells of a sketch row (a power of two) and rows; "once", "more" and "often" (from so many on) are told apart.
CELLS, DEPTH = 1 << 25, 2
OFTEN = 32
PART = 1 << 16
#: Bytes of whole texts that are handled at once, and windows that a reducer holds before it searches.
BYTES, HELD = 1 << 20, 2_000_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the row of each word from there, word hashes) of whole texts, about ``BYTES`` at a time."""
    held, size, first = [], 0, 0

    def chunk() -> tuple[int, np.ndarray, np.ndarray]:
        words, starts = hashed(b"\n".join(held))
        begins = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        return first, np.searchsorted(begins, starts, "right") - 1, words

    for row, text in enumerate(texts):
        held.append(text)
        size += len(held[-1])
        if size >= BYTES:
            yield chunk()
            held, size, first = [], 0, row + 1
    if held:
        yield chunk()


def _rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` words: differences of prefix sums, taken back to one scale."""
    n = len(words)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, base, np.uint64))
        inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(words * power[:n])]
        return mix64((total[width:] - total[: n - width + 1]) * inverse[: n - width + 1])


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over every run of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = of(out[: len(out) - step], out[step:])
        done += step
    return out


def _minimizers(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a window is whole, its least gram) by start, and the hashes of the chosen places."""
    grams = _rolling(words, GRAM, _BASES[0])
    least = _slide(grams, WINDOW - GRAM + 1, np.minimum)
    whole = rows[: len(least)] == rows[WINDOW - 1 :]
    shown = np.where(whole, least, 0)
    # A place is chosen if its gram is the least of some whole window around it.
    pad = np.zeros(WINDOW - GRAM, np.uint64)
    highest = _slide(np.r_[pad, shown, pad], WINDOW - GRAM + 1, np.maximum)
    return whole, least, grams[highest == grams]


def _cells(grams: np.ndarray) -> list[np.ndarray]:
    mixed = mix64(grams ^ np.uint64(0x51ED270B))
    return [(mixed >> np.uint64(32 * d) & np.uint64(CELLS - 1)).astype(np.int64) for d in range(DEPTH)]


def sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bitmaps (repeated, frequent) of the cells that count two or more, and ``OFTEN`` or more; of fixed size.

    Partition sketches hold up to ``OFTEN`` a cell and are merged by cell ranges.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((DEPTH, CELLS), np.uint8)
        for batch in batches:
            for _, rows, words in _chunks(raw(batch.column(0))):
                if len(words) < WINDOW:
                    continue
                for own, at in zip(cells, _cells(_minimizers(rows, words)[2]), strict=True):
                    at, n = np.unique(at, return_counts=True)
                    own[at] = np.minimum(own[at] + np.minimum(n, OFTEN).astype(np.uint8), OFTEN)
        flat = cells.reshape(-1)
        for k in range(0, DEPTH * CELLS, PART):
            used = np.flatnonzero(flat[k : k + PART])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([used.astype(np.uint16).tobytes()]), pa.array([flat[k : k + PART][used].tobytes()])], names=["part", "at", "n"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, np.uint8)
        for batch in tables:
            for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
                at = np.frombuffer(at.as_py(), np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(n.as_py(), np.uint8), OFTEN)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(np.stack([total > 1, total >= OFTEN])).tobytes()])], names=["part", "bits"])

    parts = docs.select(text).mapInArrow(count, "part int, at binary, n binary")
    bits = np.zeros((2, DEPTH * CELLS // 8), np.uint8)
    for r in parts.groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        bits[:, r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8).reshape(2, -1)
    return bits.reshape(2, DEPTH, -1)


def _told(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether every row of a sketch's bitmap holds the gram."""
    held = np.ones(len(grams), bool)
    for own, at in zip(bits, _cells(grams), strict=True):
        held &= (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return held


SEGMENTS = "gram long, doc_id long, row long, start int, n int, hashes binary"
RANGES = "doc_id long, row long, start int, n int"


def _ends(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run in which all of ``same`` are constant."""
    n = len(same[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.any([s[1:] != s[:-1] for s in same], axis=0)])
    return first, np.diff(np.r_[first, n])


def _segments(docs: DataFrame, bits: np.ndarray, text: str) -> DataFrame:
    """Runs of windows that may repeat, with one minimizer; ranges known to repeat have no hashes.

    Windows that are equal within a chunk are known to repeat; one of them goes on, so that a passage
    that all documents share sends one row a chunk.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        bits = broadcast.value
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1).to_numpy()
            for first, rows, words in _chunks(raw(batch.column(2))):
                if len(words) < WINDOW:
                    continue
                whole, least, _ = _minimizers(rows, words)
                at = np.flatnonzero(whole)
                at = at[_told(bits[0], least[at])]
                if not len(at):
                    continue
                gram, window = least[at], _rolling(words, WINDOW, _BASES[1])[at]
                gram = np.where(_told(bits[1], gram), mix64(window ^ gram), gram)
                order = np.lexsort((at, gram, window))
                begin, size = _ends(window[order], gram[order])
                repeated, leader = np.zeros(len(at), bool), np.zeros(len(at), bool)
                repeated[order] = np.repeat(size > 1, size)
                leader[order[begin]] = True
                begin_of = np.r_[0, np.flatnonzero(rows[1:] != rows[:-1]) + 1]
                start_of = begin_of[np.searchsorted(begin_of, np.arange(len(rows)), "right") - 1]
                for pick, known in ((leader, False), (repeated, True)):
                    a = at[pick]
                    g = gram[pick] if not known else np.zeros(len(a), np.uint64)
                    f, n = _ends(a - np.arange(len(a)), rows[a], g)
                    if not len(f):
                        continue
                    w = window[pick]
                    owner = rows[a[f]] + first
                    key = mix64(a[f].astype(np.uint64) + np.uint64(1)) if known else g[f]
                    hashes = [b""] * len(f) if known else [w[x : x + y].tobytes() for x, y in zip(f.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), ids.take(pa.array(owner)), pa.array(marks[owner]), pa.array((a[f] - start_of[a[f]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hashes, pa.binary())],
                        names=names,
                    )

    return docs.select("doc_id", "row", text).mapInArrow(run, SEGMENTS)


def _repeated(segments: DataFrame) -> DataFrame:
    """Ranges of windows that occur twice or more among the segments, and those known before.

    Rows of a minimizer arrive together. Of a minimizer that goes on, each distinct window is held once, so
    copies do not add up in memory.
    """

    def out(doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        if n is None:
            order = np.lexsort((at, row, doc))
            doc, row, at = doc[order], row[order], at[order]
            # Equal windows of repeated rows fall on one place.
            new = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1])] if len(at) else np.zeros(0, bool)
            doc, row, at = doc[new], row[new], at[new]
            f, n = _ends(at - np.arange(len(at)), doc, row)
            doc, row, at = doc[f], row[f], at[f]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "row", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("gram", "hash", "doc", "row", "at", "told")
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def search(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            c = {k: np.concatenate([h[k] for h in held]) for k in columns}
            order = np.lexsort((c["hash"], c["gram"]))
            c = {k: v[order] for k, v in c.items()}
            first, n = _ends(c["gram"], c["hash"])
            hit = np.repeat(n > 1, n) & ~c["told"]
            if hit.any():
                yield out(c["doc"][hit], c["row"][hit], c["at"][hit])
            going = c["gram"][first] == newest
            kept = first[going] if not last else first[:0]
            told = (n[going] > 1) | c["told"][kept] if not last else np.zeros(0, bool)
            held = [{k: v[kept] for k, v in c.items()} | {"told": told}]
            size = 0

        newest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, doc, row, at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            blobs = [b.as_py() for b in batch.column(5)]
            sizes = np.array([len(b) // 8 for b in blobs])
            known = sizes == 0
            if known.any():
                yield out(doc[known], row[known], at[known], n[known])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append({"gram": gram[owner], "hash": np.frombuffer(b"".join(blobs), np.int64), "doc": doc[owner], "row": row[owner], "at": at[owner].astype(np.int64) + step, "told": np.zeros(len(owner), bool)})
            size += len(owner)
            newest = gram[-1]
            if size > HELD:
                yield from search(False)
        if held:
            yield from search(True)

    n = partitions_for(segments.sparkSession)
    return segments.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, RANGES)


def repeated_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, start, n): starts of windows that occur elsewhere; ``row`` is the text's hash."""
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("row"), text)
    return _repeated(_segments(marked, sketch(docs, text), text))


def remove(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """``words`` without those in a window that starts in one of ``ranges`` (start, number)."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, n in ranges:
        gone[start] += 1
        gone[min(start + n + WINDOW - 1, len(words))] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left over, joined by one space."""
    ranges = persist(repeated_ranges(docs, text), "ranges")
    # A document has no more ranges than words.
    own = ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("ranges")).withColumnRenamed("doc_id", "id")
    marked = docs.select("doc_id", text, F.xxhash64(text).alias("mark"))
    joined = marked.join(own, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("id")) & (F.col("mark") == F.col("row")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                totals, kepts = [], []
                for value, found in zip(raw(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = split(value)
                    totals.append(len(words))
                    kepts.append(remove(words, [(r["start"], r["n"]) for r in found]) if found else words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()), pa.array([t - len(x) for t, x in zip(totals, kepts, strict=True)], pa.int64()), pa.array([b" ".join(x).decode("utf-8", "surrogatepass") for x in kepts], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), text, "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
