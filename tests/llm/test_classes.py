"""Edit classes of buckets with many members."""

import numpy as np
import pytest

from palimpsest.llm import edits, queries
from tests.conftest import DATA


@pytest.mark.parametrize("n", [3, 40])
def test_a_bucket_is_searched_completely(spark, n):
    bands, rng = edits.bands(), np.random.default_rng(7)
    flips, open_ = [], [set(b) - set(bands[0]) for b in bands[1:]]
    while open_:  # few bits outside the first band that touch every other band
        at = max(set().union(*open_), key=lambda p: sum(p in b for b in open_))
        flips.append(at)
        open_ = [b for b in open_ if at not in b]
    assert len(flips) <= 51
    rows = []
    for k in range(n):
        bits = rng.integers(0, 2, edits.BITS).astype(bool)
        bits[bands[0]] = True
        other = bits.copy()
        other[flips] = ~other[flips]
        rows += [(2 * k, edits.to_hex(bits)), (2 * k + 1, edits.to_hex(other))]
    found = {r.doc_id: r.class_id for r in edits.classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert found == {i: i - i % 2 for i in range(2 * n)}


def test_the_query_returns_classes(spark):
    rows = queries.op8_fingerprints(spark, DATA).collect()
    of = {}
    for r in rows:
        assert of.setdefault(r.fingerprint, r.class_id) == r.class_id and r.class_id <= r.doc_id


def test_recall_against_all_pairs(spark):
    """Of pairs just within the likeness, 95 % at least are in one class."""
    rng = np.random.default_rng(9)
    rows, n = [], 400
    for k in range(n):
        bits = rng.integers(0, 2, edits.BITS).astype(bool)
        other = bits.copy()
        other[rng.choice(edits.BITS, 51, replace=False)] ^= True
        rows += [(2 * k, edits.to_hex(bits)), (2 * k + 1, edits.to_hex(other))]
    found = {r.doc_id: r.class_id for r in edits.classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert all(found[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(n))
    assert sum(found[2 * k + 1] == 2 * k for k in range(n)) >= 0.95 * n


def test_null_and_repeated_ids(spark):
    a, b = "ab" * 64, "cd" * 64
    rows = [(None, a), (3, a), (3, a), (None, b), (None, None)]
    out = edits.classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in out) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None"), ("None", "None")]
    assert edits.classes(spark.createDataFrame([], "doc_id long, fingerprint string")).collect() == []
