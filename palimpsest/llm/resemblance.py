"""Near-duplicate documents: SimHash links first, then an exact join of shingle sets.

Documents are sets of word shingles; two are near duplicates if the Jaccard similarity of their sets is
0.8 or more. Fingerprints of a few differing bits are found through Golay-code keys (``simhash``) and verified
on the sets; that joins most copies. Four bits of a fingerprint reach a similarity of about 0.96 only, so
an exact join finds the pairs that those links leave apart. Shingles are ordered by rarity (a fixed-size sketch of their frequencies, then their hash):
such sets share a shingle among the first fifth of either, so documents meet there. Length and position
rule out most that meet; the rest are verified on their whole sets.

Equal sets are one node. In a large run of one shingle a node is first linked to a few earlier ones only;
shingles whose runs held more are searched again for all pairs that the links have not joined by then, so
that every pair is either verified or within one component.

Edge cases: null and empty texts have the empty set and are copies of each other; a text of fewer words
than a shingle is one shingle; rows are told apart by id and text, a null id comes first; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, mix64, persist, release
from .graph import components, join_spread
from .lines import _bitmap, _cell, _in_bitmap, _least_overlap, frequencies
from .parcels import PARCEL, deal, delivered, each, opened, parcels_for
from .simhash import links, majority, shingles
from .words import raw

#: Runs of up to so many nodes compare all their pairs at once.
SMALL_RUN = 16
#: Earlier nodes that a node is linked to at first in a larger run.
WITNESSES = 4
#: Rows of a run that are compared at once with a slice of it.
BLOCK, SLICE = 2048, 256


def _keys(words: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    mixed = mix64(words)
    key = np.add.reduce(mixed), np.add.reduce(mix64(mixed + np.uint64(0x9E3779B97F4A7C15)))
    return int(key[0].astype(np.int64)), int(key[1].astype(np.int64))


SETS = "doc_id long, row long, key long, key2 long, fp long, size int, words binary"


def prepare(docs: DataFrame, width: int, sketch: np.ndarray) -> DataFrame:
    """One row per document: its set's key and size, and the shingles of its prefix in their order."""
    broadcast = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = broadcast.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keys, prints, sizes, blobs = [], [], [], []
                for text in raw(part.column(2)):
                    every = shingles(text, width)
                    words = np.unique(every)
                    keys.append(_keys(words))
                    prints.append(majority(every))
                    sizes.append(len(words))
                    prefix = len(words) - -(-4 * len(words) // 5) + 1 if len(words) else 0
                    blobs.append(words[np.lexsort((words, rarity[_cell(words)]))[:prefix]].tobytes())
                key, key2 = zip(*keys, strict=True)
                columns = [pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[c.split()[0] for c in SETS.split(", ")])

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(order.alias("doc_id"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, SETS)


#: A shingle of a node's prefix as packed: shingle, place, node, the node's size and root.
ENTRIES = [np.uint64, np.int32, np.int64, np.int32, np.int64]


def _prefixes(nodes: DataFrame, parcels: int, hot: np.ndarray | None = None) -> DataFrame:
    """Parcels of the prefixes of nodes (node, size, words, root); with a bitmap, of its shingles and a few others only."""
    wanted = nodes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                blobs = [b.as_py() for b in part.column("words")]
                words, counts = np.frombuffer(b"".join(blobs), np.uint64), np.array([len(b) // 8 for b in blobs])
                owner = np.repeat(np.arange(len(blobs)), counts)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                node, size, root = (part.column(c).to_numpy()[owner] for c in ("node", "size", "root"))
                c = [words, place.astype(np.int32), node, size, root]
                if wanted.value is not None:
                    use = _in_bitmap(wanted.value, words.view(np.int64))
                    c = [x[use] for x in c]
                yield deal((mix64(c[0]) % np.uint64(parcels)).astype(np.int32), c)

    return delivered(nodes.select("node", "size", "words", "root").where("size > 0").mapInArrow(run, PARCEL))


class _Rows:
    """Rows of a shingle's run, and which pairs of them may be similar."""

    def __init__(self, word: np.ndarray, place: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray) -> None:
        order = np.argsort(word)
        same = word[order][1:] == word[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order  # a row alone meets none
        order = order[np.lexsort((node[order], word[order]))]
        self.word, self.node, self.root = word[order], node[order], root[order]
        self.size, self.place = size[order].astype(np.int64), place[order].astype(np.int64)

    def may_match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = _least_overlap(self.size[i] + self.size[j])
        room = np.minimum(self.size[i] - self.place[i], self.size[j] - self.place[j]) + np.minimum(self.place[i], self.place[j])
        return (np.minimum(self.size[i], self.size[j]) >= need) & (room >= need) & (self.root[i] != self.root[j])

    def small(self, first: np.ndarray, runs: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs of the small runs."""
        n = np.where(runs > SMALL_RUN, 0, runs)
        left = np.repeat(n, runs) - (np.arange(len(self.word)) - np.repeat(first, runs))
        at = np.flatnonzero(left > 1)
        for step in range(1, SMALL_RUN):
            at = at[left[at] > step]
            keep = at[self.may_match(at, at + step)]
            yield np.stack([keep, keep + step], axis=1)

    def witnesses(self, a: int, n: int) -> tuple[list[np.ndarray], bool]:
        """A few earlier rows for each row of a large run, and whether there were more."""
        found, more = [], False
        for b in range(a, a + n, BLOCK):
            live, got = np.arange(b, min(b + BLOCK, a + n)), np.zeros(BLOCK, np.int64)
            for k in range(a, min(b + BLOCK, a + n), SLICE):
                live = live[live > k]
                i = np.arange(k, min(k + SLICE, a + n))
                ok = (i[None, :] < live[:, None]) & self.may_match(i[None, :], live[:, None])
                rank = got[live - b][:, None] + np.cumsum(ok, axis=1)
                y, x = np.nonzero(ok & (rank <= WITNESSES))
                found.append(np.stack([i[x], live[y]], axis=1))
                got[live - b] += ok.sum(axis=1)
                full = got[live - b] > WITNESSES
                more, live = more or bool(full.any()), live[~full]
        return found, more

    def apart(self, a: int, n: int) -> Iterator[np.ndarray]:
        """All pairs of a large run with different roots: those of its commonest root meet the others only."""
        roots, counts = np.unique(self.root[a : a + n], return_counts=True)
        rest = np.flatnonzero(self.root[a : a + n] != roots[counts.argmax()]) + a
        is_rest = np.zeros(n, bool)
        is_rest[rest - a] = True
        for b in range(0, len(rest), SLICE):
            j = rest[b : b + SLICE]
            for k in range(a, a + n, BLOCK):
                i = np.arange(k, min(k + BLOCK, a + n))
                # Pairs of two of the rest are taken once, from the later of them.
                once = (i[None, :] < j[:, None]) | ~is_rest[i - a][None, :]
                y, x = np.nonzero(once & self.may_match(i[None, :], j[:, None]))
                yield np.stack([i[x], j[y]], axis=1)


def _candidates(prefixes: DataFrame, whole: bool) -> DataFrame:
    """(a, b, word): pairs of nodes that may be similar; without ``whole``, of a large run a few for each
    node, and a row of nulls and its shingle if there were others."""

    def out(rows: _Rows, pairs: np.ndarray) -> pa.RecordBatch:
        nodes = np.unique(np.sort(rows.node[pairs], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.nulls(len(nodes), pa.int64())], names=["a", "b", "word"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in each(batches):
            rows = _Rows(*opened(blobs, ENTRIES))
            if not len(rows.word):
                continue
            first = np.flatnonzero(np.r_[True, rows.word[1:] != rows.word[:-1]])
            runs = np.diff(np.r_[first, len(rows.word)])
            yield out(rows, np.concatenate(list(rows.small(first, runs))))
            again = []
            for a, n in zip(first[runs > SMALL_RUN].tolist(), runs[runs > SMALL_RUN].tolist(), strict=True):
                if whole:
                    yield from (out(rows, p) for p in rows.apart(a, n) if len(p))
                else:
                    found, more = rows.witnesses(a, n)
                    yield out(rows, np.concatenate(found))
                    if more:
                        again.append(rows.word[a])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), pa.array(np.array(again, np.uint64).view(np.int64))], names=["a", "b", "word"])

    return prefixes.mapInArrow(meet, "a long, b long, word long")


def _verified(docs: DataFrame, width: int, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = persist(nodes.join(asked, "node", "left_semi").select("node", "key", "key2", F.xxhash64("doc_id", "row").alias("at")), "asked")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick = np.flatnonzero(_in_bitmap(bits.value, batch.column(0).to_numpy())).tolist()
            sets = [np.unique(shingles(t, width)) for t in raw(batch.column(1).take(pa.array(pick, pa.int64())))]
            key, key2 = zip(*map(_keys, sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "key2", "words"])

    # The bitmap lets a few others through; the join is exact.
    read = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")).alias("at"), "text").mapInArrow(run, "key long, key2 long, words array<long>")
    sets = persist(read.join(wanted, ["key", "key2"]).select("node", "words").dropDuplicates(["node"]), "sets")
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    found = persist(found, "similar")
    drop_scratch(docs.sparkSession, sets)
    return found


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with the least node that links reach."""
    found = components(links).withColumnRenamed("root", "to")
    return nodes.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")


def _linked(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes with equal or close fingerprints: each with the least node of its fingerprint, and of a linked one."""
    prints = persist(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = nodes.join(prints.withColumnRenamed("node", "least"), "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = links(prints).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(close).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, component_id, component_row): the least row that chains of documents with similar shingle sets reach.

    ``doc_id`` is the least long for a null one, and ``row`` the text's hash.
    """
    spark = docs.sparkSession

    def sets(texts: list[bytes]) -> Iterator[np.ndarray]:
        return (np.unique(shingles(t, width)) for t in texts)

    sketch, total = frequencies(docs, "text", sets)
    parcels = parcels_for(spark, total // 5)
    wide = persist(prepare(docs, width, sketch), "wide")
    least = wide.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "row", "fp", "size", "words")).alias("first")).select("key", "key2", "first.*")
    nodes = persist(least.withColumn("node", F.monotonically_increasing_id()).withColumn("root", F.col("node")), "nodes")
    found = _verified(docs, width, nodes, persist(_linked(nodes), "linked"))
    rooted = persist(_rooted(nodes, found), "rooted")
    release(spark)
    met = persist(_candidates(_prefixes(rooted, parcels), False), "candidates")
    release(spark)
    found = found.unionByName(_verified(docs, width, nodes, met.where("word IS NULL").select("a", "b").distinct()))
    hot = met.where("word IS NOT NULL").select("word").distinct()
    if not hot.isEmpty():
        rest = _candidates(_prefixes(persist(_rooted(nodes, found), "rooted"), parcels, _bitmap(hot)), True).where("word IS NULL").select("a", "b").distinct()
        rest = persist(rest.join(met.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            found = found.unionByName(_verified(docs, width, nodes, rest))
    rooted = persist(_rooted(nodes, found).select("key", "key2", "doc_id", "row", "root"), "roots")
    classes = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("c"))
    labels = join_spread(rooted, classes, "root").select("key", "key2", F.col("c.doc_id").alias("component_id"), F.col("c.row").alias("component_row"))
    out = persist(wide.select("doc_id", "row", "key", "key2").join(labels, ["key", "key2"]).select("doc_id", "row", "component_id", "component_row"), "groups")
    for done in (wide, nodes, met):
        drop_scratch(spark, done)
    return out
