import hashlib
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text


def test_strip_removes_all_white_space(spark):
    samples = ["\t\n padded text 　", " x ", "", None, " \n "]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select(text.strip("t")).collect()
    assert [r[0] for r in rows] == [s and s.strip() for s in samples]


def test_layout_remap(spark):
    samples = {"qpple qnd wero": "apple and zero", ";orning QWqw": "morning AZaz", "zin,": "win;", "M<>": "?./"}
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.remap_layout("t")).collect()
    assert {r[0]: r[1] for r in rows} == samples


def test_hashes(spark):
    df = spark.createDataFrame([("screen", "a"), (None, None)], "k string, t string")
    rows = df.select(text.chunk_hash("k", "t"), text.blake_chunk_hash("k", "t")).collect()
    assert rows[0][0] == hashlib.sha256(b"screen\0a").hexdigest()[:24]
    assert rows[0][1] == hashlib.blake2b(b"screen\0a", digest_size=12).hexdigest()
    assert rows[1][1] == hashlib.blake2b(b"screen\0", digest_size=12).hexdigest()


@pytest.mark.parametrize(
    ("value", "limit", "want"),
    [
        ("x" * 2200, 2200, ["x" * 2200]),
        ("x" * 2201, 2200, ["x" * 2200, "x"]),
        ("x" * 5000, 2200, ["x" * 2200, "x" * 2200, "x" * 600]),
        ("\n\nab\ncd", 5, ["ab\ncd"]),
        ("\n" * 9, 5, []),
        ("", 5, [""]),
        ("abc\nxxxxxxxxxx\nd", 5, ["abc", "xxxxx", "xxxxx", "d"]),
    ],
)
def test_pieces(value, limit, want):
    assert text.pieces_of(value, limit) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n", max_size=60), st.integers(1, 9))
def test_pieces_are_short_and_lose_line_ends_only(value, limit):
    pieces = text.pieces_of(value, limit)
    assert all(len(p) <= limit for p in pieces)
    if len(value) > limit:
        assert all(pieces)
        assert "".join(pieces).replace("\n", "") == value.replace("\n", "")


def test_split_column(spark):
    df = spark.createDataFrame([("a" * 7,), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(text.split_text("t", 3)).collect()] == [["aaa", "aaa", "a"], ["ab"], None]


def test_tokens_equal_those_of_the_full_text_index(spark):
    samples = ["İstanbul IŞIK ışık Çağrı école naïve", "Ελλάδα чай Ёлка", "école", "foo-bar_baz 12,5 x", "Việt Nam", ""]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    for k, s in enumerate(samples):
        db.execute("INSERT INTO f(rowid, t) VALUES (?, ?)", (k, s))
    want = [[r[0] for r in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (k,))] for k in range(len(samples))]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select(text.tokens("t")).collect()
    assert [r[0] for r in got] == want


def test_snippet(spark):
    df = spark.createDataFrame([("x" * 280,), ("y" * 281,)], "t string")
    assert [r[0] for r in df.select(text.snippet("t")).collect()] == ["x" * 280, "y" * 280 + "…"]


def test_query_phrases():
    assert text.query_phrases('say "foo-bar" ÉCOLE -- x') == [["say"], ["foo", "bar"], ["ecole"], ["x"]]


def test_white_space_matches_python(spark):
    points = [*range(1, 0x3100)]
    df = spark.createDataFrame([(k, chr(k) + "a") for k in points if not 0xD800 <= k < 0xE000], "k int, t string")
    stripped = {r.k for r in df.where(F.char_length(text.strip("t")) == 1).collect()}
    assert stripped == {k for k in points if chr(k).isspace()}


def test_splitting_stays_in_the_jvm(spark):
    """Random lines, long ones among them, against the plain loop; no Python in the plan."""
    import random

    from pyspark.sql import functions as F

    from palimpsest.functions.text import pieces_of, split_text

    rng = random.Random(3)
    texts = ["\n".join(rng.choice("aé\U0001f600") * rng.choice([0, 0, 1, 5, 9, 10, 11, 20, 21, 47]) for _ in range(rng.randrange(1, 9))) for _ in range(500)] + [None, "", "\n" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_text("t", 10).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.p == (None if r.t is None else pieces_of(r.t, 10))
