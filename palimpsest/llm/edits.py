"""Document fingerprints by a randomised edit embedding.

A text is read by a random walk that all texts share: at each step of the walk the current character is
written out, and a bit drawn for the step and the character's class says whether to move on. Texts
a few edits apart fall into step again soon after each edit, so their outputs differ in few places
(edit distance becomes Hamming distance). A fingerprint takes one bit of each of 512 places of the
output; the places depend on the length only, and hardly move when it changes (jump hashing).
Likeness is the share of equal bits, scaled so that unrelated texts are near 0. Fingerprints with a
likeness of 0.8 or more are one class: they meet in bands of sampled bits and are verified there.

Edge cases: a null text counts as an empty one, whose fingerprint is that of padding alone; equal
texts have equal fingerprints; ties of ids are ordered by text, a null id comes first; the only
document of a table is followed by itself; a class is named by its least id, ids that are null aside;
equal fingerprints are one node whatever their ids; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, mix64, partitions_for, persist
from .graph import classed, components, join_hot
from .lines import _bitmap, _in_bitmap
from .parcels import PARCEL, ROWS, deal, delivered, each, opened

BITS = 512
CLASSES = 16
#: The walk's random bits repeat after so many steps; no step waits longer than ``WAIT``.
PERIOD, WAIT = 1 << 18, 64
#: Characters walked before the place is taken back into the period.
STRIDE = 2048
SEED = 0x5EED
FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(maxsize=1)
def _waits() -> list[bytes]:
    """For each class and step: the steps until the walk leaves the character."""
    length = PERIOD + STRIDE * WAIT + WAIT
    out = []
    for c in range(CLASSES):
        step = np.arange(length, dtype=np.uint64) % np.uint64(PERIOD)
        moves = (mix64(step * np.uint64(CLASSES) + np.uint64(c) + np.uint64(SEED << 32)) & np.uint64(1)).astype(bool)
        at = np.where(moves, np.arange(length), length + WAIT)
        following = np.minimum.accumulate(at[::-1])[::-1]
        out.append(np.minimum(following - np.arange(length) + 1, WAIT).astype(np.uint8).tobytes())
    return out


@lru_cache(maxsize=20_000)
def _places(domain: int) -> np.ndarray:
    """A place below ``domain`` for each bit; growing the domain by one moves few of them."""
    if domain < 1:
        return np.zeros(BITS, np.int64)
    key = mix64(np.arange(1, BITS + 1, dtype=np.uint64))
    place, ahead = np.zeros(BITS, np.int64), np.zeros(BITS, np.int64)
    open_ = np.ones(BITS, bool)
    with np.errstate(over="ignore"):
        while open_.any():
            place = np.where(open_, ahead, place)
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            ahead = ((place + 1) * (2.0**31 / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            open_ &= ahead < domain
    return place


class Walk:
    """Where each character of a text begins in the output; can be continued after a prefix."""

    def __init__(self, text: str, start: int = 0) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            classes = ((self.codes * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8).tobytes()
        waits, at, base = _waits(), start % PERIOD, start - start % PERIOD
        parts = [np.zeros(0, np.int64)]
        for k in range(0, len(classes), STRIDE):
            out = []
            put = out.append
            for c in classes[k : k + STRIDE]:
                put(at)
                at += waits[c][at]
            parts.append(np.array(out, np.int64) + base)
            base, at = base + at - at % PERIOD, at % PERIOD
        self.starts = np.concatenate(parts)
        self.end = base + at


def _bits(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The fingerprint's bits: of the character at each place, or of padding."""
    place = _places(2 * len(codes))
    if len(codes):
        char = np.where(place < end, codes[np.searchsorted(starts, place, "right") - 1].astype(np.uint64) + np.uint64(1), np.uint64(0))
    else:
        char = np.zeros(BITS, np.uint64)
    return (mix64(char * np.uint64(BITS) + np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(bool)


def fingerprint(text: str) -> np.ndarray:
    walk = Walk(text)
    return _bits(walk.codes, walk.starts, walk.end)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 2.0 * float(np.count_nonzero(a == b)) / BITS - 1.0)


def to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the first as many characters of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Doc:
    """A document read once: its walk serves its own and its edited text's fingerprint."""

    def __init__(self, doc_id: int, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.walk = Walk(text)
        self.bits = _bits(self.walk.codes, self.walk.starts, self.walk.end)

    def against(self, following: _Doc) -> tuple:
        w, n = self.walk, len(self.text)
        kept = n - n // 4
        changed = edited(self.text, following.text)
        tail = Walk(changed[kept:], int(w.starts[kept]) if kept < n else w.end)
        bits = _bits(np.concatenate([w.codes[:kept], tail.codes]), np.concatenate([w.starts[:kept], tail.starts]), tail.end)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, n, sha, to_hex(self.bits), to_hex(bits), likeness(self.bits, bits), likeness(self.bits, following.bits))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, doc_id, text), sorted: each range of ids ends with the next range's first row.

    The driver holds one bound and one first id per range; every text is shuffled once.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "left"))

    firsts = sorted((r[0], r[1]) for r in rows.select("at").groupBy(part_of("at").alias("part")).agg(F.min("at")).collect())
    # A range's first row is also the last thing that the range before it reads.
    before = {at: firsts[k - 1][0] for k, (_, at) in enumerate(firsts)}
    heads = np.array(sorted(before), np.int64)
    owners = np.array([before[int(h)] for h in heads], np.int64)

    @F.pandas_udf("array<long>")
    def parts_of(at: pd.Series) -> pd.Series:
        values = at.to_numpy()
        own = np.searchsorted(bounds, values, "left")
        k = np.minimum(np.searchsorted(heads, values), max(len(heads) - 1, 0))
        is_head = heads[k] == values if len(heads) else np.zeros(len(values), bool)
        return pd.Series([[int(p), int(owners[i])] if h else [int(p)] for p, h, i in zip(own, is_head, k, strict=True)])

    placed = rows.select(F.posexplode(parts_of("at")).alias("ahead", "part"), "at", "doc_id", "text")
    dealt = placed.repartitionById(len(bounds) + 1, F.col("part").cast("int"))
    return dealt.sortWithinPartitions("part", "ahead", "at", "text").select("part", "ahead", "doc_id", "text")


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and its likeness to that and to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FINGERPRINTED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, part = None, None
        for batch in batches:
            rows = []
            for p, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if p != part:
                    last, part = None, p
                if ahead and last is None:
                    continue
                doc = _Doc(doc_id, text.as_py())
                if last is not None:
                    rows.append(last.against(doc))
                last = None if ahead else doc
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return with_next(docs).mapInArrow(run, FINGERPRINTED)


#: Bits of a band, bands, and the likeness that makes a link.
BAND_BITS, BANDS, LIKE = 28, 64, 0.8
#: Buckets of up to so many fingerprints give all their pairs; larger ones are searched with the fingerprints at hand.
SMALL_BUCKET = 8


def bands() -> np.ndarray:
    """The places of each band's bits."""
    rng = np.random.RandomState(SEED % (1 << 32))
    return np.array([sorted(rng.choice(BITS, BAND_BITS, replace=False).tolist()) for _ in range(BANDS)])


def _banded(nodes: DataFrame, parcels: int, asked: np.ndarray | None = None) -> DataFrame:
    """Parcels of (bits, node) for each band of each fingerprint; a parcel is a part of one band.

    With a bitmap of keys (band and bits), of those and a few others only, and with the fingerprints.
    """
    wanted = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = bands()
        weight = np.int64(1) << np.arange(BAND_BITS, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                node = part.column(0).to_numpy()
                prints = np.frombuffer(bytes.fromhex("".join(part.column(1).to_pylist())), np.uint64).reshape(-1, BITS // 64)
                bits = np.unpackbits(prints.view(np.uint8), axis=1)
                for band, at in enumerate(places):
                    key = bits[:, at].astype(np.int64) @ weight
                    pick = np.arange(len(key)) if wanted.value is None else np.flatnonzero(_in_bitmap(wanted.value, key | band << BAND_BITS))
                    if len(pick):
                        parcel = (band * parcels + key[pick] % parcels).astype(np.int32)
                        columns = [key[pick].astype(np.int32), node[pick]]
                        yield deal(parcel, columns if wanted.value is None else [*columns, prints[pick]])

    return delivered(nodes.select("node", "fingerprint").mapInArrow(run, PARCEL))


def _pairs(batches: Iterator[pa.RecordBatch], parcels: int) -> Iterator[pa.RecordBatch]:
    """(a, b, key): all pairs of small buckets, and nulls with the key of a larger one."""
    for parcel, blobs in each(batches):
        key, node = opened(blobs, [np.int32, np.int64])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        left = np.repeat(np.where(size > SMALL_BUCKET, 0, size), size) - (np.arange(len(key)) - np.repeat(first, size))
        for step in range(1, SMALL_BUCKET):
            at = np.flatnonzero(left > step)
            found = np.sort(np.stack([node[at], node[at + step]], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(at), pa.int64())], names=["a", "b", "key"])
        large = key[first[size > SMALL_BUCKET]].astype(np.int64) | parcel // parcels << BAND_BITS
        none = pa.nulls(len(large), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(large)], names=["a", "b", "key"])


def _spans(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that span what is alike in each bucket: each found member is searched from once."""
    for _, blobs in each(batches):
        key, node, bits = opened(blobs, [np.int32, np.int64, (np.uint64, BITS // 64)])
        order = np.lexsort((node, key))
        key, node, bits = key[order], node[order], bits[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rest, a, b = np.arange(lo, hi), [], []
            while len(rest):
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    at = queue.pop()
                    close = np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64) <= most
                    found, rest = rest[close], rest[~close]
                    a += [node[at]] * len(found)
                    b += node[found].tolist()
                    queue.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def labels(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """(fingerprint, class_id) of the distinct fingerprints: bit-sampled bands, verification, components.

    Each bucket of a band is searched completely: a small one by all its pairs, a large one by a search
    that spans what is alike in it, so that large groups of near copies make few links.
    """
    spark = prints.sparkSession
    distinct = prints.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    nodes = persist(distinct.withColumn("node", F.monotonically_increasing_id()), "prints")
    parcels = nodes.count() // ROWS + 1
    most = int(np.floor(BITS * (1 - least) / 2 + 1e-9))
    met = persist(_banded(nodes, parcels).mapInArrow(lambda batches: _pairs(batches, parcels), "a long, b long, key long").distinct(), "pairs")
    part = lambda c, k: F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long")
    apart = sum((F.bit_count(part("x", k).bitwiseXOR(part("y", k))) for k in range(BITS // 64)), F.lit(0))
    pairs = met.where("key IS NULL").select("a", "b")
    sides = nodes.select("node", "fingerprint")
    links = pairs.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b").where(apart <= most).select("a", "b")
    large = met.where("key IS NOT NULL").select("key")
    if not large.isEmpty():
        spans = _banded(nodes, parcels, _bitmap(large)).mapInArrow(lambda batches: _spans(batches, most), "a long, b long")
        links = links.unionByName(spans.distinct())
    found = components(links)
    roots = persist(nodes.join(found, "node", "left").select("fingerprint", "least", "root"), "roots")
    out = persist(classed(roots, "class_id").select("fingerprint", "class_id"), "labels")
    for done in (met, nodes, roots):
        drop_scratch(spark, done)
    return out


def classes(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """(doc_id, class_id) from (doc_id, fingerprint); the class is its least id, none without a fingerprint."""
    return join_hot(prints, labels(prints, least), "fingerprint", "left").select("doc_id", "class_id")


def classified(docs: DataFrame) -> DataFrame:
    """``against_next`` with the class of each document's fingerprint; hexadecimal strings travel as bytes."""
    hexed = ["fingerprint", "edited_fingerprint", "edited_sha256"]
    found = against_next(docs)
    columns = found.columns
    prints = persist(found.withColumns({c: F.unhex(c) for c in hexed}), "fingerprinted")
    named = labels(prints.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint")))
    # A fingerprint may be that of a third of all documents.
    joined = join_hot(prints, named.select(F.unhex("fingerprint").alias("fingerprint"), "class_id"), "fingerprint")
    return joined.select(*(F.lower(F.hex(c)).alias(c) if c in hexed else F.col(c) for c in columns), "class_id")
