"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments. Any two words of 23 bits that differ in two
places or fewer lie near one common codeword of the perfect Golay code, where "near" is a distance
of three, or of four for words that are three away from their own codeword; so a segment has one or
six codeword indices. Four differing bits leave, by the pigeonhole principle, either a segment
without errors and another with two or fewer, or two segments with one error each (so that a half
of either is equal) and a third with two or fewer. Keys made of the equal bits and a codeword index
of the other segment hold 33 bits or more, and no pair within the distance escapes them.

Edge cases: a null or empty text has fingerprint zero and links like any other; equal fingerprints
are one node of the graph however many rows have them; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, persist
from .graph import classed, components
from .words import raw

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code of length 23.
GENERATOR = 0xC75
#: Keys of so many fingerprints are made at once.
BLOCK = 1024
#: Runs of up to so many fingerprints compare all their pairs at once.
SMALL_RUN = 8


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles in their order; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    flat = b" ".join(text.lower().split())
    if not flat:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(spaces) < width:
        return np.array([xxh64_intdigest(flat, SEED)], np.uint64)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(flat)][width - 1 :]
    return np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; equal shingles count as often as they occur."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[k : k + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in raw(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64, copy=True)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


class Golay:
    """Codeword indices near a word of 23 bits: one, or six if its own codeword is three away."""

    def __init__(self) -> None:
        errors = [sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)]
        syndromes = _remainders(np.array(errors))
        self.errors = np.zeros((2048, 6), np.int64)
        self.count = np.zeros(2048, np.int64)
        for e, s in zip(errors, syndromes.tolist(), strict=True):
            self.errors[s, self.count[s]] = e
            self.count[s] += 1
        self.low, self.high = _remainders(np.arange(4096)), _remainders(np.arange(2048) << 12)

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices as (n, 6) and which of them hold."""
        s = self.low[words & 4095] ^ self.high[words >> 12]
        return (words[:, None] ^ self.errors[s]) >> 11, np.arange(6) < self.count[s][:, None]


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint) for signed 64-bit fingerprints."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.indices(p) for p in parts]
    halves = [(p & 1023, p >> 10) for p in parts]
    keys, owners, kind = [], [], 0
    row = np.broadcast_to(np.arange(len(fps))[:, None], (len(fps), 6))

    def put(equal: np.ndarray, third: int) -> None:
        nonlocal kind
        index, holds = near[third]
        keys.append((((kind << 24 | equal) << 12)[:, None] | index)[holds])
        owners.append(row[holds])
        kind += 1

    for third in range(3):
        first, second = (k for k in range(3) if k != third)
        put(parts[first], third)
        put(parts[second], third)
        for a in halves[first]:
            for b in halves[second]:
                put(a << 12 | b, third)
    return np.concatenate(keys), np.concatenate(owners)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of a signed number it would count the magnitude's bits


def _tree(run: np.ndarray) -> np.ndarray:
    """Links that join what is joined in a large run: each found member is searched from once."""
    links, rest = [], np.sort(run)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = _within(rest, at)
            if close.any():
                found = rest[close]
                links.append(np.stack([np.full(len(found), at), found], axis=1))
                queue.extend(found)
                rest = rest[~close]
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def links(fps: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that span every class of close ones.

    Rows with one key meet in sorted runs. A run costs its length times what remains apart, and
    memory for its distinct fingerprints only, so that large groups of close copies stay cheap.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_fps = batch.column(0).to_numpy()
            for k in range(0, len(all_fps), BLOCK):
                part = np.ascontiguousarray(all_fps[k : k + BLOCK])
                keys, owners = keys_of(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], names=["key", "fp"])

    def search(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        found = [_tree(fps[a : a + n]) for a, n in zip(first[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist(), strict=True)]
        span = np.repeat(np.where(size > SMALL_RUN, 0, size), size) - (np.arange(len(keys)) - np.repeat(first, size))
        for step in range(1, SMALL_RUN):
            at = np.flatnonzero(span > step)
            close = at[_within(fps[at], fps[at + step])]
            found.append(np.stack([fps[close], fps[close + step]], axis=1))
        pairs = np.concatenate(found)
        return np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, fps = np.r_[keys, batch.column(0).to_numpy()], np.r_[fps, batch.column(1).to_numpy()]
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            if whole > 100_000:
                yield out(search(keys[:whole], fps[:whole]))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield out(search(keys, fps))

    n = partitions_for(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(expand, "key long, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the least id that links reach from the document."""
    fps = persist(fingerprints(docs, width), "fingerprints")
    nodes = persist(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = persist(nodes.join(components(links(nodes)), nodes.fp == F.col("node"), "left").select("fp", "least", "root"), "roots")
    labels = classed(roots, "component_id").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
