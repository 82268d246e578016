import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import attribution, blocks, dedup, health, search, texts

ROW = "stream_key long, id long, timestamp string, app string, window string, url string, text string, content_hash long"


def test_first_occurrence_keeps_rows_without_a_hash(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, None), (5, 6)], "id long, content_hash long")
    assert sorted(r.id for r in dedup.first_occurrence(df).collect()) == [1, 3, 4, 5]


def test_consecutive_equal_texts_go_across_windows(spark):
    df = spark.createDataFrame([(0, 1, "a", "x"), (0, 2, "b", "x"), (0, 3, "b", "y"), (0, 4, "b", "x"), (1, 5, "b", "x")], "stream_key long, id long, app string, text string")
    assert sorted(r.id for r in dedup.drop_consecutive(df).collect()) == [1, 3, 4, 5]


def fold(rows, limit):
    """Blocks, as the rules say them, one row after another."""
    out, context, length = [], object(), 0
    for r in rows:
        if (r[3], r[4]) != context or length >= limit:
            out.append([])
            context, length = (r[3], r[4]), 0
        length += len(r[6]) + bool(out[-1])
        out[-1].append(r)
    return [(b[0][1], b[-1][1], len(b), "\n".join(r[6] for r in b), b[0][5]) for b in out]


def without_repeats(rows):
    return [r for k, r in enumerate(rows) if not k or (r[0], r[6]) != (rows[k - 1][0], rows[k - 1][6])]


@pytest.mark.parametrize("seed", range(6))
def test_session_blocks(spark, seed):
    rng = random.Random(seed)
    calm = seed % 2  # few changes, so that islands span buckets and groups of them
    app, window = (lambda: rng.choice("a" * 40 + "b"), lambda: "w") if calm else (lambda: rng.choice(["a", None, ""]), lambda: rng.choice(["w", None]))
    rows = [(s, 100 * s + k, str(k), app(), window(), f"u{k}", rng.choice("xy") * rng.choice([12, 12, 30, 79, 80, 200]), None) for s in range(3) for k in range(90)]
    for distinct in (False, True):
        kept = without_repeats(rows) if distinct else rows
        want = sorted(b for s in range(3) for b in fold([r for r in kept if r[0] == s], 80))
        got = blocks.session_blocks(spark.createDataFrame(rows, ROW), 80, distinct, size=(1, 5, 16)[seed // 2], group=3).collect()
        assert sorted((r.frame_start, r.frame_end, r.n_frames, r.text, r.url) for r in got) == want


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_one_stream_in_buckets(spark, size):
    rng = random.Random(size)
    rows = [(0, k, str(k), rng.choice("ab"), rng.choice(["w", None]), None, rng.choice("xyz") * 12, None) for k in range(60)]
    df = spark.createDataFrame(rows, ROW)
    kept = without_repeats(rows)
    assert sorted(r.id for r in dedup.drop_consecutive(df, size=size).collect()) == [r[1] for r in kept]
    want, island = {}, 0
    for k, r in enumerate(rows):
        island += not k or rows[k - 1][3:5] != r[3:5]
        want[r[1]] = island
    assert {r.id: r.island for r in blocks.islands(df, size=size).collect()} == want


def test_rows_alike_are_one_and_nothing_gives_nothing(spark):
    row = (0, 1, "t", "a", None, None, "x" * 20, 5)
    got = blocks.session_blocks(spark.createDataFrame([row, row], ROW)).collect()
    assert [(r.n_frames, r.text, r.src_hashes) for r in got] == [(1, "x" * 20, [5])]
    for out in (blocks.session_blocks, blocks.islands, dedup.drop_consecutive):
        assert out(spark.createDataFrame([], ROW)).collect() == []


def test_a_long_island_is_many_tasks_work(spark):
    """A million rows of one app: as many blocks as the rule says, from sixteen buckets."""
    lengths = "12 + id * 7919 % 301"
    rows = spark.range(1_000_000).selectExpr("0L AS stream_key", "id", "cast(id as string) AS timestamp", "'a' AS app", "'w' AS window", "cast(null as string) AS url", f"repeat('x', cast({lengths} as int)) AS text", "id AS content_hash")
    want, start, length = [], 0, -1
    for k in range(1_000_000):
        if length >= 2200:
            want.append((start, k - 1))
            start, length = k, -1
        length += 13 + k * 7919 % 301
    want.append((start, 999_999))
    got = blocks.session_blocks(rows)
    assert sorted((r.frame_start, r.frame_end) for r in got.select("frame_start", "frame_end").collect()) == want
    assert "hashpartitioning(stream_key" not in got._jdf.queryExecution().toString()


def test_length_cap(spark):
    rows = [(0, k, str(k), "a", "w", None, "x" * n, k) for k, n in enumerate([1000, 1300, 50, 2300, 10])]
    got = blocks.session_blocks(spark.createDataFrame(rows, ROW)).orderBy("frame_start").collect()
    assert [(r.frame_start, r.frame_end) for r in got] == [(0, 1), (2, 3), (4, 4)]
    assert [r.src_hashes for r in got] == [[0, 1], [2, 3], [4]]
    pieces = blocks.chunks_of(blocks.session_blocks(spark.createDataFrame(rows, ROW)), "screen").orderBy("frame_start", "piece_no").collect()
    assert max(len(p.text) for p in pieces) <= 2200
    assert [p.src_hashes for p in pieces if p.piece_no] == [[] for p in pieces if p.piece_no]


def test_text_priority(spark):
    df = spark.createDataFrame([(" long enough text ", "other text here"), ("short", "\tother text here"), ("short", "brief"), (None, None)], "a string, o string")
    got = [r[0] for r in df.select(blocks.usable_text(F.col("a"), F.col("o"))).collect()]
    assert got == ["long enough text", "other text here", None, None]


def test_nearest_frame(spark):
    f = spark.createDataFrame([(1, "2024-01-01T00:00:00"), (2, "2024-01-01T00:10:00"), (3, "2024-01-01T02:00:00")], "id long, timestamp string")
    cases = {10: "00:00:00", 11: "00:05:00", 12: "00:05:01", 13: "01:55:00", 14: "01:54:59", 15: "00:15:00", 16: "02:05:01"}
    e = spark.createDataFrame([(k, f"2024-01-01T{t}") for k, t in cases.items()], "id long, timestamp string")
    got = {r.id: r.frame for r in attribution.nearest(e, f).collect()}
    assert got == {10: 1, 11: 1, 12: 2, 13: 3, 15: 2}


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_nearest_in_crowded_windows(spark, size):
    """Frames and events of a few seconds, in streams, with ties: against all frames of the stream."""
    rng = random.Random(size)
    at = lambda: f"2024-01-01T00:00:{rng.randrange(30):02d}.{rng.randrange(2) * 5}"
    f = [(k, rng.choice([1, 2, None]), rng.choice([at(), None, "never"])) for k in range(120)]
    e = [(k, rng.choice([1, 2, 3, None]), rng.choice([at(), at(), "2024-01-01T09:00:00", "?"])) for k in range(60)]
    us = lambda t: int(t[11:13]) * 3_600_000_000 + int(float(t[17:]) * 1e6) if t and t[0] == "2" else None
    for stream in (None, "s"):
        want = {}
        for k, s, t in e:
            near = [(abs(us(t) - us(u)), us(u), n) for n, r, u in f if us(t) is not None and us(u) is not None and (stream is None or (r == s and s is not None))]
            if near and min(near)[0] <= 300_000_000:
                want[k] = min(near)[2]
        schema = "id long, s int, timestamp string"
        got = attribution.nearest(spark.createDataFrame(e, schema), spark.createDataFrame(f, schema), stream=stream, size=size)
        assert {r.id: r.frame for r in got.collect()} == want


def test_a_hundred_thousand_frames_in_one_window(spark):
    f = spark.range(100_000).selectExpr("id", "timestamp_micros(1704067200000000 + id * 1000) AS timestamp")
    e = spark.range(50_000).selectExpr("id", "timestamp_micros(1704067200000400 + id * 2000) AS timestamp")
    out = attribution.nearest(e, f)
    assert out.where("frame <> id * 2 OR apart_us <> 400").count() == 0 and out.count() == 50_000


def test_attribution_fills_only_what_is_missing(spark):
    f = spark.createDataFrame([(1, "2024-01-01T00:00:00", "app", None, "url")], "id long, timestamp string, app_name string, window_name string, browser_url string")
    e = spark.createDataFrame([(7, "2024-01-01T00:01:00", "", "own", None), (8, "2024-01-01T00:01:00", "mine", None, None), (9, "2024-01-02T00:00:00", None, None, None)], "id long, timestamp string, app string, window string, url string")
    got = {r.id: (r.app, r.window, r.url) for r in attribution.attribute(e, f).collect()}
    assert got == {7: ("app", "own", "url"), 8: ("mine", None, None), 9: (None, None, None)}


TEXTS = ["foo-bar baz", "foo baz bar", "bar foo", "the cat the dog", "École naïve", "dog " * 30, "nothing at all here", "foo bar foo bar", "İstanbul ışık", "cat"]


@pytest.mark.parametrize("query", ["foo", "foo-bar", "the dog", "ecole cat cat", "bar-foo baz", "istanbul", "...", "zebra"])
def test_bm25_equals_the_full_text_index(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(TEXTS))
    match = " OR ".join(f'"{w}"' for w in query.split())
    want = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)))
    chunks = spark.createDataFrame([(k, "screen", t) for k, t in enumerate(TEXTS)], "id long, kind string, text string")
    got = {r.id: r.bm25 for r in search.bm25(chunks, query).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    posted = {r.id: r.bm25 for r in search.bm25_postings(search.postings_of(chunks), query).collect()}
    assert posted == pytest.approx(want, abs=1e-9)


def test_postings_of_repeated_tokens_and_null_texts(spark):
    chunks = spark.createDataFrame([(1, "screen", "a a a b a"), (2, "typed", None), (3, "typed", ""), (4, "typed", "b a b a")], "id long, kind string, text string")
    posted = search.postings_of(chunks)
    assert sorted((r.token, r.id, r.length, r.positions) for r in posted.rows.collect()) == [("a", 1, 5, [0, 1, 2, 4]), ("a", 4, 4, [1, 3]), ("b", 1, 5, [3]), ("b", 4, 4, [0, 2])]
    assert posted.totals.collect() == [(4, 9)]
    for query in ("a-a", "b-a-b", "a-a-b c", "..."):
        for kind in (None, "typed"):
            assert sorted(search.bm25_postings(posted, query, kind).collect()) == sorted(search.bm25(chunks, query, kind).collect())
    none = search.postings_of(chunks.where("false"))
    assert none.totals.collect() == [(0, 0)] and not search.bm25_postings(none, "a").collect()


@pytest.mark.parametrize("kind", [None, "typed"])
def test_the_best_without_reading_all_parts(spark, kind):
    """Chunks of many lengths and frequencies: the same fifty, and most parts are not read."""
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        words = ["filler"] * int(2 ** rng.uniform(2, 10))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(["sea", "ship", "rose"])
        rows.append((k, "typed" if k % 5 == 0 else "screen", " ".join(words)))
    chunks = spark.createDataFrame(rows, "id long, kind string, text string")
    posted = search.postings_of(chunks)
    posted = search.Postings(posted.rows.persist(), posted.totals.persist(), posted.tops.persist())
    for query in ("sea", "sea ship", "rose rose ship", "filler", "nowhere"):
        want = search.bm25(chunks, query, kind).orderBy("bm25", "id").limit(50).collect()
        best = search.bm25_best(posted, query, 50, kind)
        got = best.found.collect()
        assert [r.id for r in got] == [r.id for r in want] and [r.bm25 for r in got] == pytest.approx([r.bm25 for r in want], abs=1e-9)
        if query in ("sea", "sea ship"):
            assert len(best.read) < (0.5 if query == "sea" else 0.7) * len(best.parts)
    assert search.bm25_best(posted, "sea-ship", 5, kind).found.collect() == search.bm25_postings(posted, "sea-ship", kind).orderBy("bm25", "id").limit(5).collect()


def test_the_nearest_without_reading_all_rings(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(k, unit([x + rng.gauss(0, 0.15) for x in centres[k % 20]])) for k in range(4000)] + [(9000, rows_tie := unit(centres[3])), (9001, rows_tie)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    pivots = search.pivots_of(vectors, 32)
    cells = search.celled(vectors, pivots).persist()
    shares = []
    for q in (rows[17][1], unit(centres[3]), unit([1.0] * 8)):
        found, share = search.knn_best(cells, search.rings_of(cells), pivots, q, 20)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in search.knn(vectors, q, 20).collect()]
        shares.append(share)
    assert shares[0] < 0.5 and shares[1] < 0.5
    assert search.knn_best(cells.where("false"), search.rings_of(cells.where("false")), pivots, q, 5)[0].collect() == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(1, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.score for r in search.fuse(a, b).collect()}
    assert got == pytest.approx({1: 2 / 61, 2: 1 / 62, 3: 1 / 62})


def test_hybrid_fills_a_rare_kind_and_prints(spark):
    chunks = spark.createDataFrame(
        [(k, "typed" if k % 40 == 0 else "screen", "t", "app", None, "u" if k else None, 1, f"word{k} shared\nline") for k in range(400)],
        "id long, kind string, ts_start string, app string, window string, url string, n_frames int, text string",
    )
    vectors = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(400)], "id long, embedding array<float>")
    rows = search.hybrid(chunks, vectors, "shared word80", [400.0, 0.0], 8, "typed").collect()
    assert len(rows) == 8 and {r.kind for r in rows} == {"typed"}
    assert len(search.hybrid(chunks, vectors, "zzz", [0.0, 0.0], 0).collect()) == 1
    printed = search.as_text(rows[:1], "q", 50, 50)
    assert "app / ?" in printed and "shared line" in printed


def test_health(spark):
    f = spark.createDataFrame([(1, "2024-01-01T00:00:00"), (9, "2024-01-02T11:55:00")], "id long, timestamp string")
    o = spark.createDataFrame([(9, "abc"), (1, "zzzz")], "frame_id long, text string")
    e = spark.createDataFrame([(1, "text", "2024-01-02T00:00:00"), (2, "clipboard", "2024-01-01T00:00:00")], "id long, event_type string, timestamp string")
    c = spark.createDataFrame([(1,)], "id long")
    r = health.snapshot(f, o, e, c, "2024-01-02 12:00:00", watermark=4, service_up=False).first()
    assert (r.status, r.frame_age_s, r.frames_24h, r.frames_total, r.text_chars_24h, r.ui_text_24h, r.clipboard_24h, r.true_lag) == ("degraded", 300, 1, 2, 3, 1, 0, 5)
    assert health.snapshot(f, o, e, c, "2024-01-02 12:30:00", service_up=False).first().status == "stale"
    assert health.snapshot(f.where("false"), o, e, c, "2024-01-02 12:30:00").first().status == "degraded"


def test_rows_with_keys_of_their_texts_give_the_same(spark):
    """Blocks, chunks, islands and kept rows by key against those of rows that hold their texts; no text is written with the rows."""
    rng = random.Random(0)
    said = [rng.choice("abc") * rng.choice([12, 30, 79, 80, 200]) for _ in range(9)] + [" pad ded text  ", "x" * 12]
    rows = [(s, 100 * s + k, str(k), rng.choice("ab"), rng.choice(["w", None]), f"u{k}", rng.choice(said).strip(), rng.choice([None, k])) for s in range(3) for k in range(20)]
    full = spark.createDataFrame(rows, ROW)
    keyed = full.withColumns({"key": texts.key_of(F.col("text")), "length": F.char_length("text")}).drop("text")
    stored = texts.stored(spark.createDataFrame([(t,) for t in said], "text string"))
    for distinct in (True,):
        found = blocks.shared_blocks(keyed, 80, distinct)
        got = found.join(texts.joined(found, stored), "sequence").select("frame_start", "frame_end", "n_frames", "text", "url", "src_hashes")
        want = blocks.session_blocks(full, 80, distinct).select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        columns = ["frame_start", "n_frames", "piece_no", "chunk_hash"]
        cut = blocks.shared_chunks(found, stored, "screen", 100)
        assert "keys" not in cut.columns and "text" not in cut.columns
        whole = blocks.chunks_of(blocks.session_blocks(full, 80, distinct), "screen", 100)
        assert sorted(cut.select(*columns).collect()) == sorted(whole.select(*columns).collect())
    kept = dedup.drop_consecutive(full)
    assert sorted(r.id for r in dedup.drop_consecutive(keyed, "key", length="length").collect()) == sorted(r.id for r in kept.collect())
    want = {r.id: r.island for r in blocks.islands(kept).collect()}
    assert {r.id: r.island for r in blocks.islands(keyed, text="key", length="length", distinct=True).collect()} == want


def test_health_counts_characters_before_texts_meet_frames(spark):
    f = spark.range(3).selectExpr("id", "'2024-01-02T00:00:00' AS timestamp")
    o = spark.range(3).selectExpr("id AS frame_id", "repeat('x', cast(id as int)) AS text")
    plan = health.text_metrics(o, f, "2024-01-02 12:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("length(")
    assert health.text_metrics(o, f, "2024-01-02 12:00:00").first().text_chars_24h == 3


def test_strip_takes_every_white_space_and_no_other(spark):
    from palimpsest.functions.text import WHITE_SPACE, strip

    points = [k for k in range(1, 0x3100)]
    df = spark.createDataFrame([(f"{chr(k)}a b{chr(k)}",) for k in points], "t string")
    other = F.regexp_replace("t", f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")
    assert df.where(~strip("t").eqNullSafe(other)).count() == 0
    assert df.where(strip("t") == "a b").count() == 29


@pytest.mark.parametrize("name", ["c5_text_priority", "f4_session_blocks", "f2_one_stream"])
def test_texts_are_trimmed_once_a_document(spark, name, monkeypatch):
    """The queries over events do not join texts to all events: what they write before their last step has no text."""
    from palimpsest.operators import ordered, scratch
    from palimpsest.plans import catalog
    from tests.conftest import DATA

    seen, write = [], scratch.written
    watched = lambda df, label: (seen.append((label, df.columns)), write(df, label))[1]
    for module in (ordered, blocks, dedup):
        monkeypatch.setattr(module, "written", watched)
    monkeypatch.setattr(catalog, "_with_text", None)
    assert catalog.queries()[name](spark, DATA).columns
    assert not [label for label, columns in seen if label != "placed" and {"text", "accessibility_text", "ocr"} & set(columns)]


def test_postings_are_made_without_a_shuffle(spark):
    chunks = spark.createDataFrame([(k, "screen", f"a b{k} a") for k in range(50)], "id long, kind string, text string")
    rows = search.postings_of(chunks).rows
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.token, r.id, r.positions) for r in rows.collect()) == sorted([("a", k, [0, 2]) for k in range(50)] + [(f"b{k}", k, [1]) for k in range(50)])
