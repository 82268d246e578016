"""The manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import manifest

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest("".join(map(said, (doc_id, source, lang, n_chars, text))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    steps = []
    for level in levels[:-1]:
        run = at // 3 * 3
        steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return steps


def slow_manifest(rows):
    """Result rows as text, in no order."""
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    levels = {name: levels_of([leaf_of(*r) for r in trees[name]]) for name in names}
    top = levels_of([levels[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            steps = way(levels[name], at) + way(top, k)
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf_of(row[0], text, *row[2:])
            for left, right in steps:
                now = digest(left + now + right)
            root = top[-1][0]
            out.append((row[0], levels[name][0][at], levels[name][-1][0], root, digest("".join(a + b for a, b in steps)), now, now == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 81, "b": 82, "c": 1}, {"a": 700, "": 4, None: 3, "é": 250}, {f"s{k}": 1 + k % 4 for k in range(100)}])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(100_000 * k + j * 7, None if j % 11 == 5 else f"text\n{j} é" * (j % 3), "en" if j % 5 else None, name, None if j % 7 == 3 else j) for k, (name, n) in enumerate(sizes.items()) for j in range(n)]
    got = manifest.manifest(spark.createDataFrame(rows, ROW).repartition(5))
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_manifest(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, "c\n", "en", "s", 2), (None, "x\ny", None, "s", None), (None, None, None, None, None), (2, "", "", "", 0)]
    assert sorted(str(tuple(r)) for r in manifest.manifest(spark.createDataFrame(rows, ROW)).collect()) == slow_manifest(rows)


def test_a_null_is_not_an_empty_string(spark):
    df = spark.createDataFrame([(1, None, "", "s", 0), (1, "", None, "s", 0)], ROW)
    assert df.select(manifest.leaf([F.col(c) for c in manifest.FIELDS])).distinct().count() == 2
