"""Line dedup: frequent words, hot runs, repeated and null ids, and what its steps cost."""

import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import lines, words
from tests.llm.test_brute_force import slow_lines

SCHEMA = "doc_id long, text string"


def crowd(rng, vocabulary, n, size):
    """Documents of a few lines over a closed vocabulary, many alike."""
    out = {}
    for i in range(n):
        rows = [" ".join(f"w{k}" for k in rng.choice(vocabulary, rng.integers(2, size), replace=False)) for _ in range(3)]
        out[i] = "\n".join([*rows, *(" ".join([*r.split()[1:], "new"]) for r in rows[:1])])
    return out


@pytest.mark.parametrize("frequent,paired", [(2, 128), (5, 8), (40, 16), (20_000, 128)])
def test_frequent_words_meet_in_pairs(spark, monkeypatch, frequent, paired):
    monkeypatch.setattr(lines, "PAIRED", paired)
    monkeypatch.setattr(lines, "WITNESSES", 3)
    monkeypatch.setattr(lines, "SMALL_RUN", 4)
    texts = crowd(np.random.default_rng(11), 18, 120, 17)
    got = lines.dedup(spark.createDataFrame(list(texts.items()), SCHEMA), frequent=frequent)
    assert {r.doc_id: r.text for r in got.collect()} == slow_lines(texts)


def test_lines_are_cut_out_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lines, "BYTES", 40)
    monkeypatch.setattr(lines, "LINES", 7)
    texts = crowd(np.random.default_rng(12), 40, 40, 12) | {50: "\n\n" + "long " * 40 + "\n\nlong\n", 51: "", 52: "\n"}
    got = lines.dedup(spark.createDataFrame(list(texts.items()), SCHEMA))
    assert {r.doc_id: r.text for r in got.collect()} == slow_lines(texts)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "one line of its own\n\nand a second one"), (1, "one line of its own\n\nand a second one"), (1, "another text with this id"), (None, "a text without any id"), (None, "a text without any id"), (None, "a second text without id"), (2, "a text without any id"), (3, None), (3, None)]
    out = lines.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_lines, r.n_removed) for r in out)
    assert kept == sorted(
        [(1, "one line of its own\n\nand a second one", 2, 0), (1, "", 2, 2), (1, "another text with this id", 1, 0), (-1, "a text without any id", 1, 0), (-1, "", 1, 1), (-1, "a second text without id", 1, 0), (2, "", 1, 1), (3, "", 0, 0), (3, "", 0, 0)]
    )


def entries(keys, sizes, bitmaps):
    """Lines that meet at ``keys``, at their first word."""
    n = len(keys)
    sizes, none = np.array(sizes, np.int32), np.zeros(n, np.uint64)
    return [np.array(keys, np.uint64), sizes, sizes, np.array(bitmaps, np.uint64), none, np.arange(n), np.zeros(n, np.int32), np.arange(n)]


def small_pairs(c):
    rows = lines._Rows(c)
    first = np.flatnonzero(np.r_[True, rows.key[1:] != rows.key[:-1]])
    runs = np.diff(np.r_[first, len(rows.key)])
    return sorted((int(rows.id[a]), int(rows.id[b])) for some in rows.small(first, runs) for a, b in some)


@pytest.mark.parametrize("longest", [15, 4095])
def test_bitmaps_of_lines_of_like_size_alone_are_compared(monkeypatch, longest):
    compared = []
    apart = lines._Rows.apart
    monkeypatch.setattr(lines._Rows, "apart", lambda self, i, j: compared.append(len(i)) or apart(self, i, j))
    monkeypatch.setattr(lines, "LONGEST", longest, raising=False)
    rng = np.random.default_rng(13)
    keys, sizes = np.repeat([5, 6, 1 << 63], 30), rng.permutation(np.repeat(4 * 2 ** np.arange(9), 10))
    bitmaps = rng.choice(8, 90)
    want = []
    for a, b in combinations(range(90), 2):
        least, most = sorted((int(sizes[a]), int(sizes[b])))
        if keys[a] == keys[b] and 5 * least >= 4 * most and 9 * int(bitmaps[a] ^ bitmaps[b]).bit_count() <= least + most:
            want.append((a, b))
    assert small_pairs(entries(keys, sizes, bitmaps)) == want
    alike = sum(int(keys[a] == keys[b] and sizes[a] == sizes[b]) for a, b in combinations(range(90), 2))
    assert sum(compared) == alike < 3 * 30 * 29 // 2


def test_lines_asked_for_are_told_for_many_documents_at_once(monkeypatch):
    texts = [b"", b"one", b"a\nb\n\nc", b"\n"] * 500 + [b"\n".join([b"x"] * 70)]
    ids, marks = np.arange(len(texts), dtype=np.int64), np.arange(len(texts), dtype=np.int64) * 7
    bits = np.zeros(1 << 17, np.uint8)
    for r, k in ((2, 3), (3, 1), (1000, 0), (2000, 0), (2000, 69)):
        at = int(lines._named(ids[r : r + 1], marks[r : r + 1], np.array([k]))[0]) % (1 << 20)
        bits[at >> 3] |= 128 >> (at & 7)
    slow = {}
    for r, text in enumerate(texts):
        n = np.arange(text.count(b"\n") + 1)
        found = n[lines._in_bitmap(bits, lines._named(np.full(len(n), ids[r]), np.full(len(n), marks[r]), n))]
        if len(found):
            slow[r] = found.tolist()
    named, calls = lines._named, []
    monkeypatch.setattr(lines, "_named", lambda *a: calls.append(1) or named(*a))
    assert dict(lines._picked(bits, ids, marks, texts)) == slow
    assert len(calls) == 1
    monkeypatch.setattr(lines, "LINES", 50)
    assert dict(lines._picked(bits, ids, marks, texts)) == slow
    assert len(calls) > 50
    assert list(lines._picked(bits, ids[:0], marks[:0], [])) == []


class Captured:
    """Stands for a table and keeps the function that its tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        self.task = task
        raise InterruptedError


def test_counting_words_costs_no_more_than_hashing_them():
    rng = np.random.default_rng(14)
    text = " ".join(f"word{k}" for k in rng.integers(0, 200_000, 1_500_000))
    docs = Captured()
    with pytest.raises(InterruptedError):
        lines.frequencies(docs)

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    parts = list(docs.task(iter([batch])))
    assert sum(int(np.frombuffer(n.as_py(), np.uint32).sum()) for p in parts for n in p.column("n")) == 1_500_000
    assert least(lambda: list(docs.task(iter([batch])))) < 2 * least(lambda: words.hashed(text.encode()))
