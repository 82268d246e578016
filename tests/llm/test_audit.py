"""The filter audit against every order applied to every document in plain Python."""

import re
from itertools import permutations

import pytest

from palimpsest.llm import audit, queries
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", range(6))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in audit.swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) and set(seen) == set(permutations(range(n)))


def failed(doc_id, text, texts):
    words = WORD.findall(text)
    bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)}
    bad |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(t == text and i is not None and i < doc_id for i, t in texts)}
    return {f for f in bad if bad[f]}


def slow_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    texts = [(i, t or "") for i, t, _ in docs]
    first = {}
    for i, t in texts:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = {}
    for (i, t), (_, _, lang) in zip(texts, docs, strict=True):
        bad = failed(i, t, [(first.get(t), t)])
        parts.setdefault(lang or "", []).append((bad, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removals = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removals[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out.extend((*x[:-1], removals[x[-1]]) for x in lines)
    return sorted(out)


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = sorted(tuple(r) for r in queries.queries()["op12_filter_audit"](spark, DATA).collect())
    assert got == slow_audit(docs, labels)
    assert sum(r[4] for r in got) > 0 and len(got) == 600 * len({d[2] for d in docs})


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", ""), (3, "same words", "en"), (3, "same words", "en"), (4, "same words", "de"), (None, "same words", "en"), (None, None, "en"), (5, "SHOUT #", "en"), (6, "a " * 250, "en")]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in found) == slow_audit(docs, labels)
    assert audit.audit(d.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
