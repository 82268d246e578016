"""Packing token sequences by column generation.

Every document is cut into full sequences and one shorter tail. Tails are packed by a cutting-stock
linear program over the histogram of their lengths, counted in units of eight ids: patterns are
columns, a knapsack dynamic programme prices new ones, the rounded solution gives slots, and pieces
take slots in their rank order. The driver holds the histogram (one number per length) and the
patterns only; both are bounded by the sequence length, whatever the size of the corpus. Units keep
the program small; they leave about half a unit a piece unused.

Edge cases: a null or empty text is a document of the end token alone; equal rows are packed each by
itself (ranks break ties by id and start); an empty table packs into nothing; further columns of the
input are not carried along.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, persist

END = 0
CAPACITY = 1024
#: Lengths are rounded up to units for the linear program.
UNIT = 8
#: Stop pricing when the bound shows that the program is within this part of its optimum.
GAP = 1e-4
MAX_ROUNDS = 6000
#: Distinct segments whose ids a task remembers.
CACHED = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class SegmentIds(dict):
    """Little-endian ids of segments that the pre-tokenizer always keeps apart."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = array("I", self.encode(segment)).tobytes()
        if len(segment) < 64:
            self[segment] = ids
        return ids


#: White space beside a separator could be joined with it: such texts are encoded in one piece.
_LOOSE = re.compile(r"\s[ \n]|[ \n]\s|^\s|\s\Z")


@lru_cache(maxsize=2)
def byte_encoder(ranks_path: str):
    """text -> ids as little-endian bytes; the vocabulary's end marker is a token if a text has it."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    codec = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    known = SegmentIds(lambda s: codec.encode(s, allowed_special="all"))

    def encode(text: str) -> bytes:
        if _LOOSE.search(text):
            return array("I", codec.encode(text, allowed_special="all")).tobytes()
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(known["\n"])
            first, *rest = line.split(" ")
            out.append(known[first])
            out.extend([known[" " + w] for w in rest])
        return b"".join(out)

    return encode


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: full sequences of ``capacity`` ids, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(ranks_path or tokenizer_path())
        end = array("I", [END]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Patterns with how often each is used: ``(times, {length: copies})``."""

    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable pattern: an unbounded knapsack over the lengths."""
    value = np.full(capacity + 1, -np.inf)
    value[lengths] = values
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (best[c - 1 :: -1] + value[1 : c + 1]).max())
    pattern: Counter[int] = Counter()
    c = capacity
    while c > 0 and best[c] > 1e-12:
        if best[c] == best[c - 1]:
            c -= 1
            continue
        taken = int(np.argmax(best[c - 1 :: -1] + value[1 : c + 1])) + 1
        pattern[taken] += 1
        c -= taken
    return float(best[capacity]), dict(pattern)


def _fit(left: Counter[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """What rounding left over, longest first into the fullest sequence that has room."""
    room: dict[int, list[Counter[int]]] = {}
    for length in sorted(left.elements(), reverse=True):
        free = min((r for r in room if r >= length and room[r]), default=None)
        used = room[free].pop() if free is not None else Counter()
        used[length] += 1
        room.setdefault((capacity if free is None else free) - length, []).append(used)
    grouped = Counter(tuple(sorted(u.items())) for same in room.values() for u in same)
    return [(n, dict(items)) for items, n in sorted(grouped.items(), reverse=True)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns that hold every piece of the histogram, by column generation and rounding."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return Plan()
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    at = {int(x): k for k, x in enumerate(lengths)}
    columns = [{int(x): capacity // int(x)} for x in lengths]
    inverse = np.diag([1 / c[int(x)] for c, x in zip(columns, lengths, strict=True)])
    bound = 0.0
    for _ in range(MAX_ROUNDS):
        used = inverse @ need
        duals = inverse.sum(axis=0)
        value, pattern = _price(np.maximum(duals, 0), lengths, capacity)
        bound = max(bound, used.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or used.sum() - bound <= GAP * bound:
            break
        step = sum(inverse[:, at[x]] * n for x, n in pattern.items())
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        row = inverse[leaves] / step[leaves]
        step[leaves] = 0
        touched = np.flatnonzero(step)
        inverse[touched] -= np.outer(step[touched], row)
        inverse[leaves] = row
        columns[leaves] = pattern
    times = np.floor(np.maximum(inverse @ need, 0) + 1e-6).astype(np.int64)
    left = Counter({x: histogram[x] for x in at})
    whole = []
    for n, pattern in zip(times.tolist(), columns, strict=True):
        n = min([n, *(left[x] // c for x, c in pattern.items())])
        if n > 0:
            whole.append((n, pattern))
            for x, c in pattern.items():
                left[x] -= n * c
    return Plan(whole + _fit(+left, capacity), bound)


def _slots(p: Plan) -> np.ndarray:
    """Rows (units, first rank, copies, first sequence, first slot), sorted by units and rank."""
    rows, taken, sequence = [], Counter(), 0
    for n, pattern in p.patterns:
        slot = 0
        for units, copies in sorted(pattern.items(), reverse=True):
            rows.append((units, taken[units], copies, sequence, slot))
            taken[units] += n * copies
            slot += copies
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, the place among the pieces of as many units by id and start.

    Ranges of the sorted pieces are counted by themselves, so that a very common length is no
    single task's work; only a count per range and length is gathered.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("units").to_numpy()
            first = np.flatnonzero(np.r_[True, length[1:] != length[:-1]]) if len(length) else np.zeros(0, int)
            sizes = np.diff(np.r_[first, len(length)])
            ranks = np.arange(len(length)) - np.repeat(first, sizes)
            if len(length):
                if length[0] == last:
                    ranks[: sizes[0]] += seen
                last, seen = int(length[-1]), int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part)), pa.array(ranks)], names=[*batch.schema.names, "part", "place"])

    order = ["units", "doc_id", "start"]
    ranges = pieces.repartitionByRange(partitions_for(pieces.sparkSession), *order).sortWithinPartitions(*order)
    placed = persist(ranges.mapInArrow(number, f"{PIECES}, units long, part long, place long"), "ranked")
    sizes = placed.groupBy("units", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range and one more per length: bounded by the ranges and the sequence length.
    firsts = sizes.select("units", "part", before.alias("before"))
    return placed.join(F.broadcast(firsts), ["units", "part"]).withColumn("rank", F.col("before") + F.col("place"))


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = persist(cut(docs, capacity, ranks_path), "pieces").withColumn("units", F.ceil(F.col("length") / UNIT))
    histogram = {int(x): int(n) for x, n in pieces.groupBy("units").count().collect()}
    slots = _slots(plan(histogram, capacity // UNIT))
    shift = np.int64(1) << np.int64(50)
    keys = slots[:, 0] * shift + slots[:, 1]
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, units = batch.column("rank").to_numpy(), batch.column("units").to_numpy()
            slot = slots[np.searchsorted(keys, units * shift + rank, "right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            turn, copies = rank - slot[:, 1], np.maximum(slot[:, 2], 1)
            places = [pa.array(slot[:, 3] + turn // copies), pa.array(slot[:, 4] + turn % copies)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *places], names=[*kept, "sequence_id", "slot"])

    placed = _ranked(pieces).mapInArrow(assign, f"{PIECES}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*kept, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
