"""Toxicity: planted insults, slopes against differences, what a score may depend on, and the same scores in plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toxicity

INSULTS = ["blorgface", "snarkwit", "grumphead", "vilstrum"]


def planted(n, seed=3, inflected=False):
    """Documents of a few sentences; in every sixth one sentence holds an insult, inflected where asked for."""
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(n):
        sentences = [rng.choices(plain, k=rng.randint(4, 10)) for _ in range(rng.randint(1, 8))]
        toxic = int(k % 6 == 0)
        if toxic:
            insult = rng.choice(INSULTS) + ("".join(rng.choices("abcdefgh", k=3)) if inflected else "")
            rng.choice(sentences).insert(1, insult)
        rows.append((k, ". ".join(" ".join(s) for s in sentences) + "!", toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = planted(900)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_held_out_documents_are_told_apart(spark, tables):
    docs, labels, rows = tables
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert min(s for s, y in held if y) > 0.7 > max(s for s, y in held if not y)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_inflected_words_share_their_beginning(spark):
    rows = planted(1200, 5, inflected=True)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.98


def test_scores_depend_on_texts_alone(spark, tables):
    """Labels of the held-out fold, ids and languages change nothing; nor does how rows are dealt."""
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs.repartition(7), flipped.repartition(3))
    assert np.array_equal(model.features, again.features) and np.array_equal(model.weights, again.weights) and model.bias == again.bias
    moved = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    scores = lambda d: [r.score for r in toxicity.score(d, model).orderBy("doc_id").collect()]
    assert scores(docs) == scores(moved)


def test_the_offending_sentences_are_found(spark, tables):
    docs, labels, rows = tables
    found = {(r.doc_id, r.sentence) for r in toxicity.offences(docs, toxicity.train(docs, labels)).collect()}
    want = {(i, s.strip()) for i, t, _ in rows for s in re.split(r"[.!]", t) if any(w in s for w in INSULTS)}
    assert len(want & found) / len(want) > 0.98 and len(found - want) <= 2


def test_scores_in_plain_python(spark, tables):
    """Sentence by sentence and word by word, from the same features."""
    docs, labels, rows = tables
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def features(word):
        return toxicity._words_of(word.encode())[0][:, 0].tolist()

    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[:120]:
        missed, n = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = re.findall(r"[a-z0-9]+", sentence)
            if words:
                z = model.bias + sum(weight.get(f, 0.0) for w in words for f in features(w))
                missed, n = missed * (1 - 1 / (1 + math.exp(-z))), n + 1
        assert got[i].score == pytest.approx(1 - missed, abs=1e-9) and got[i].n_sentences == n


def test_slopes():
    rng = np.random.default_rng(2)
    toxic, plain = np.array([1, 0, 1, 0]), np.array([2, 0, 0, 5])
    sizes = pa.array([[1, 2], [3], [2], []], pa.list_(pa.int32()))
    slots = pa.array([[0, 1, 2], [2, 3, 3], [4, 0], []], pa.list_(pa.int32()))
    weights, bias = rng.normal(size=5), -1.3
    slopes, of_bias, _ = toxicity.gradient(toxic, plain, sizes, slots, weights, bias)
    loss = lambda w, b: toxicity.gradient(toxic, plain, sizes, slots, w, b)[2]
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert slopes[k] / toxicity.UNIT == pytest.approx((loss(weights + step, bias) - loss(weights - step, bias)) / 2e-6, abs=1e-5)
    assert of_bias / toxicity.UNIT == pytest.approx((loss(weights, bias + 1e-6) - loss(weights, bias - 1e-6)) / 2e-6, abs=1e-5)


def test_without_labels_nothing_is_toxic(spark, tables):
    docs, labels, _ = tables
    for none in (labels.where("false"), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.judge(docs.limit(20), none).agg(F.max("score"), F.sum("predicted")).first()[:] == (0.0, 0)


def test_odd_texts(spark, tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    long = " ".join(["plain words"] * 400_000) + " blorgface"
    rows = [(1, None), (2, ""), (3, " .!\n"), (4, "\0blorgface\0"), (None, "blorgface"), (5, long), (5, long)]
    got = {}
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[k][0].score for k in (1, 2, 3)] == [0.0] * 3 and got[4][0].score == got[None][0].score > 0.7
    assert got[5][0].score == got[5][1].score > 0.7 and got[5][0].n_offending == 1


def test_a_bound_on_training(spark, tables):
    docs, labels, _ = tables
    n = toxicity.training(docs, labels, 100).count()
    assert 40 < n < 180 and toxicity.training(docs, labels).count() > 500
