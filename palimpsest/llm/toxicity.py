"""Toxicity from document labels: sentences are scored, a document is toxic if any of its sentences is.

Multiple-instance learning: a document is a bag of sentences, of which only the bag has a label. A sentence's score is a
logistic function of its words; the bag's is their noisy-or, 1 - prod(1 - p). Both are trained together by gradient steps on
the bags' likelihood, so that of a toxic document's sentences those explain its label which clean documents do not have.

A word counts as itself and as its first four and six bytes, lower-cased, each hashed to one of 2^22 features; so inflected
forms share what they are known by. Features are screened first: those that the labels of documents bear out (a likelihood ratio
and an odds ratio) take part, all others weigh nothing. Training bags then hold a few numbers each, and every step is a Spark job
over them whose result is one number a feature, summed as integers: the model is the same however rows are dealt.

Edge cases: a null text counts as an empty one, and a text without words scores zero; a null id has no label and is not held
out; of several labels of an id the greatest counts; without labels of both kinds, or without a feature that the labels bear
out, every score is zero; rows that repeat are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import drop_scratch, mix64, persist

FEATURES = 1 << 22
#: Bytes of a word's beginning that are features of their own.
PREFIXES = 4, 6
#: Labelled documents to train on at most, about: beyond that a share of them is drawn by the hash of their ids.
TRAINED = 100_000
#: A feature takes part from this likelihood ratio (of one in a thousand by chance) and odds ratio on.
EVIDENCE, ODDS = 10.83, 2.0
STEPS, RATE, RIDGE = 60, 0.35, 5e-5
#: Gradients travel as integers of this unit.
UNIT = float(1 << 32)
OFFENDING = 0.5
#: Bytes of text that a task looks at together.
PORTION = 4 << 20

_WORD = np.ones(256, bool)
_WORD[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_LOW = [(1 << 8 * k) - 1 for k in range(9)]


class Model(NamedTuple):
    """Weights of the features that take part, and a sentence's bias: 2^22 numbers at most."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts joined by NUL: features of every word (one row each), its text, its sentence, its first byte.

    A word is a run of letters, digits and bytes above ASCII; a sentence ends with ``.!?`` or a line end.
    """
    raw = np.frombuffer(text + b"\0" * 9, np.uint8)
    n = len(text)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[raw[:n]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    plain = np.where(inside[1:-1], raw[:n], 0x20).astype(np.uint8)
    whole, found = words.hashed(plain.tobytes())
    assert len(found) == len(starts)
    eight = np.ndarray((n + 2,), "<u8", buffer=raw, strides=(1,))
    rows = [whole]
    for k in PREFIXES:
        head = mix64((eight[starts] & np.uint64(_LOW[k])) ^ np.uint64(k << 56))
        rows.append(np.where(size > k, head, whole))
    breaks = _STOP[raw[:n]] | (raw[:n] == 0)
    sentence = np.cumsum(breaks)
    doc = np.cumsum(raw[:n] == 0)
    at = starts if len(starts) else np.zeros(0, np.int64)
    return (np.stack(rows) & np.uint64(FEATURES - 1)).astype(np.int64), doc[at], sentence[at], starts


def _portions(texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(first, one past the last, their bytes) of the texts, some megabytes at a time. NUL stands between texts and nowhere else."""
    lows = [t.lower().replace("\0", " ").encode("utf-8", "surrogatepass") for t in texts]
    first, held = 0, 0
    for k, t in enumerate(lows):
        held += len(t)
        if held >= PORTION or k == len(lows) - 1:
            yield first, k + 1, b"\0".join(lows[first : k + 1])
            first, held = k + 1, 0


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that is never trained on."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, most: int = TRAINED) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold; about ``most`` of them at most.

    With that bound the labels are a few megabytes, so they are sent to the documents, whose texts do not move.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = persist(known.withColumn("toxic", (F.col("toxic") == 1).cast("int")), "labels")
    count = known.count()
    if count > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / count)))
    return persist(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), "training")


def screen(train: DataFrame, evidence: float = EVIDENCE, odds: float = ODDS) -> tuple[np.ndarray, float]:
    """Features that the labels bear out, in order, and the rate of toxic documents.

    Documents with a feature are counted in each task first, so that a shuffle sees a feature once a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for a, _, text in _portions(_texts(batch)):
                features, doc, _, _ = _words_of(text)
                pairs = np.unique((doc[None, :] << 22 | features).ravel())
                for label in (0, 1):
                    seen[label] += np.bincount(pairs[toxic[a + (pairs >> 22)] == label] & (FEATURES - 1), minlength=FEATURES)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1][some]), pa.array(seen[0][some])], names=["f", "a", "b"])

    both = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    p, n = both.get(1, 0), both.get(0, 0)
    if not p or not n:
        return np.zeros(0, np.int64), p / max(p + n, 1)
    counts = train.mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    a, b, share = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / float(p + n)
    ratio = 2 * (part(a, share * p) + part(b, share * n) + part(p - a, (1 - share) * p) + part(n - b, (1 - share) * n))
    apart = F.abs(F.log((a + 0.5) / (p - a + 0.5)) - F.log((b + 0.5) / (n - b + 0.5)))
    found = counts.where((ratio >= evidence) & (apart >= float(np.log(odds)))).select("f").toPandas()["f"]  # 2^22 numbers at most
    return np.sort(found.to_numpy(np.int64)), p / (p + n)


def bags(train: DataFrame, features: np.ndarray) -> DataFrame:
    """(toxic, plain, sizes, slots): a document's sentences without features, and of the others how many, and which."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of = np.full(FEATURES, -1, np.int32)
        slot_of[features] = np.arange(len(features), dtype=np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            rows: list[tuple] = []
            for a, z, text in _portions(_texts(batch)):
                found, doc, sentence, _ = _words_of(text)
                slots = slot_of[found]
                every = np.unique(doc << 40 | sentence)
                in_doc = np.bincount(every >> 40, minlength=z - a)
                pairs = np.unique(((doc << 40 | sentence)[None, :] + np.zeros_like(slots, np.int64))[slots >= 0], return_counts=True)
                order = np.argsort(np.broadcast_to(doc << 40 | sentence, slots.shape)[slots >= 0], kind="stable")
                held = slots[slots >= 0][order]
                of_doc = pairs[0] >> 40
                for k in range(z - a):
                    low, high = np.searchsorted(of_doc, [k, k + 1])
                    before, after = pairs[1][:low].sum(), pairs[1][:high].sum()
                    rows.append((toxic[a + k], int(in_doc[k] - (high - low)), pairs[1][low:high].tolist(), held[before:after].tolist()))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["toxic", "plain", "sizes", "slots"])

    return persist(train.mapInArrow(pack, "toxic int, plain long, sizes array<int>, slots array<int>"), "bags")


def _chances(z: np.ndarray) -> np.ndarray:
    return np.where(z == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 30))))


def gradient(toxic: np.ndarray, plain: np.ndarray, sizes: pa.ListArray, slots: pa.ListArray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
    """(slope of each weight, of the bias, log-likelihood) of some bags under noisy-or."""
    per_bag = np.diff(np.asarray(sizes.offsets))
    size, slot = np.asarray(sizes.flatten()), np.asarray(slots.flatten())
    bag = np.repeat(np.arange(len(per_bag)), per_bag)
    sentence = np.repeat(np.arange(len(size)), size)
    p = _chances(bias + np.bincount(sentence, weights[slot], len(size)))
    p0 = float(_chances(np.array([bias]))[0])
    none = plain * np.log1p(-p0) + np.bincount(bag, np.log1p(-p), len(per_bag))
    hit = np.maximum(-np.expm1(none), 1e-12)
    pull = np.where(toxic == 1, np.exp(none) / hit, -1.0)
    each = p * pull[bag]
    units = np.rint(each * UNIT)
    slopes = np.bincount(slot, units[sentence], len(weights))
    loss = np.where(toxic == 1, np.log(hit), none).sum()
    return slopes, units.sum() + np.rint(plain * p0 * pull * UNIT).sum(), float(loss)


def fit(held: DataFrame, features: np.ndarray, rate: float, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Full-batch steps with a step size for each weight from its past slopes."""
    n, sentences = held.agg(F.count("*"), F.sum(F.col("plain") + F.size("sizes"))).first()
    start = float(np.log(max(rate, 1e-6) * n / max(sentences or 1, 1) * 0.5))
    x = np.append(np.zeros(len(features)), start)
    slow, fast = np.zeros_like(x), np.zeros_like(x)

    def slopes(weights: np.ndarray, bias: float):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weights) + 1, np.int64)
            for batch in batches:
                by_slot, of_bias, _ = gradient(np.asarray(batch.column("toxic")), np.asarray(batch.column("plain")), batch.column("sizes"), batch.column("slots"), weights, bias)
                total += np.append(by_slot, of_bias).astype(np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "slope"])

        return task

    for k in range(1, steps + 1):
        found = held.mapInArrow(slopes(x[:-1].copy(), float(x[-1])), "slot long, slope long").groupBy("slot").agg(F.sum("slope").alias("slope")).toPandas()
        g = np.zeros_like(x)
        g[found["slot"].to_numpy()] = found["slope"].to_numpy(np.float64) / UNIT / n
        g[:-1] -= ridge * x[:-1]
        slow, fast = 0.9 * slow + 0.1 * g, 0.99 * fast + 0.01 * g * g
        x = x + RATE * (slow / (1 - 0.9**k)) / (np.sqrt(fast / (1 - 0.99**k)) + 1e-8)
    return Model(features, x[:-1], float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINED) -> Model:
    spark = docs.sparkSession
    rows = training(docs, labels, most)
    features, rate = screen(rows)
    if not len(features):
        drop_scratch(spark, rows)
        return Model(features, np.zeros(0), float("-inf"))
    held = bags(rows, features)
    model = fit(held, features, rate)
    for done in (rows, held):
        drop_scratch(spark, done)
    return model


def _scored(text: bytes, n: int, table: np.ndarray, bias: float) -> tuple[np.ndarray, ...]:
    """Of ``n`` texts joined by NUL: document scores; and of every sentence with words its document, first byte and score."""
    found, doc, sentence, starts = _words_of(text)
    key, first, inverse = np.unique(sentence, return_index=True, return_inverse=True)
    p = _chances(bias + np.bincount(inverse, table[found].sum(axis=0), len(key)))
    of = doc[first] if len(first) else np.zeros(0, np.int64)
    whole = -np.expm1(np.bincount(of, np.log1p(-p), n))
    return whole, of, starts[first] if len(first) else of, p, key


def _table(model: Model) -> np.ndarray:
    table = np.zeros(FEATURES)
    table[model.features] = model.weights
    return table


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, n_offending) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            rows = np.zeros((3, len(batch)))
            for a, z, text in _portions(_texts(batch)):
                whole, of, _, p, _ = _scored(text, z - a, table, model.bias)
                rows[:, a:z] = whole, np.bincount(of, minlength=z - a), np.bincount(of[p >= OFFENDING], minlength=z - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(rows[0], 0, 1)), pa.array(rows[1].astype(np.int64)), pa.array(rows[2].astype(np.int64))], names=["doc_id", "score", "n_sentences", "n_offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, score double, n_sentences long, n_offending long")


def offences(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """(doc_id, sentence, score): the sentences that offend, as they stand in the text, lower-cased."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for a, z, text in _portions(_texts(batch)):
                _, of, starts, p, _ = _scored(text, z - a, table, model.bias)
                ends = np.flatnonzero(_STOP[np.frombuffer(text, np.uint8)] | (np.frombuffer(text, np.uint8) == 0))
                for k in np.flatnonzero(p >= least):
                    at = np.searchsorted(ends, starts[k])
                    stop = ends[at] if at < len(ends) else len(text)
                    rows.append((ids[a + of[k]], text[starts[k] : stop].decode("utf-8", "replace"), float(p[k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column("doc_id").type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, sentence string, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = TRAINED) -> DataFrame:
    """Trains on the labels and scores every document: (doc_id, held_out, score, predicted, n_sentences, n_offending)."""
    found = score(docs, train(docs, labels, most))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "n_offending")
