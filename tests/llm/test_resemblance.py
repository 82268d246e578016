"""The pipeline's near duplicates against all pairs in plain Python."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import resemblance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_all_pairs(texts):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sorted(texts), 2):
            if least[a] != least[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i for i in texts if least[i] == i}


def edited(rng, words, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"new{rng.integers(1 << 40)}"
    return words


@pytest.mark.parametrize("witnesses", [resemblance.WITNESSES, 1])
def test_near_duplicates_reach_the_similarity(spark, monkeypatch, witnesses):
    monkeypatch.setattr(resemblance, "WITNESSES", witnesses)
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    bases = [draw(int(n)) for n in rng.integers(60, 300, 12)]
    texts = [edited(rng, b, max(1, len(b) // d)) for b in bases for d in (30, 50, 60, 90)]
    passage = draw(200)
    texts += [passage + draw(int(n)) for n in rng.integers(10, 60, 60)]  # a shared passage: long runs, few of them similar
    texts += [edited(rng, bases[0], 3) for _ in range(60)] + bases + [bases[1], [], [], ["one"], ["One"], ["two", "words"]]
    rows = {k: " ".join(t) for k, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows.items()], SCHEMA).repartition(4)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = kept_by_all_pairs(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert 20 < len(want) < len(rows) - 60
