import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.functions.embedding import HashingEmbedder, HttpEmbedder
from palimpsest.operators import index, search
from palimpsest.operators.index import Index
from palimpsest.sources.sqlite import read_sqlite
from palimpsest.streaming import ingest

FRAME = "id long, timestamp string, app_name string, window_name string, browser_url string, content_hash long, accessibility_text string, ocr string, stream_key long"
DIM = 16


def frames(spark, ids):
    rows = [(k, f"2024-01-01T00:{k:02d}:00", "app", "w" if k % 7 else "v", None, k % 9 if k % 5 else None, f"text of frame {k // 2} " * 3, None, 0) for k in ids]
    return spark.createDataFrame(rows, FRAME)


def content(index):
    return sorted((r.kind, r.chunk_hash, r.frame_start, r.frame_end, r.text) for r in index.chunks().collect())


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, index = str(tmp_path / "src"), Index(spark, str(tmp_path / "idx"))
    frames(spark, range(20)).coalesce(1).write.parquet(source)
    ingest.ingest_frames(spark, source, index, str(tmp_path / "cp"), HashingEmbedder(DIM))
    first = content(index)
    assert first
    ingest.ingest_frames(spark, source, index, str(tmp_path / "cp"), HashingEmbedder(DIM))
    assert content(index) == first
    frames(spark, range(20, 40)).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_frames(spark, source, index, str(tmp_path / "cp"), HashingEmbedder(DIM))
    assert len(content(index)) > len(first) and set(first) <= set(content(index))
    hashes = [c[1] for c in content(index)]
    assert len(hashes) == len(set(hashes))
    assert {len(r.embedding) for r in index.chunks().collect()} == {DIM}


def test_a_failed_batch_is_replayed_without_traces(spark, tmp_path):
    source = str(tmp_path / "src")
    frames(spark, range(20)).coalesce(1).write.parquet(source)
    whole = Index(spark, str(tmp_path / "a"))
    ingest.ingest_frames(spark, source, whole, str(tmp_path / "ca"), HashingEmbedder(DIM))
    broken = Index(spark, str(tmp_path / "b"))
    write = broken.write_batch

    def fails(batch, new, embedder):
        write(batch, new, embedder)
        raise RuntimeError("killed after the write")

    broken.write_batch = fails
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_frames(spark, source, broken, str(tmp_path / "cb"), HashingEmbedder(DIM))
    broken.write_batch = write
    ingest.ingest_frames(spark, source, broken, str(tmp_path / "cb"), HashingEmbedder(DIM))
    assert content(broken) == content(whole)


def test_resplit_and_reset(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    row = ("screen", 1, 1, "t", "t", "a", "w", None, 1, 0, [])
    schema = "kind string, frame_start long, frame_end long, ts_start string, ts_end string, app string, window string, url string, n_frames int, piece_no int, src_hashes array<long>, text string, chunk_hash string"
    new = spark.createDataFrame([(*row, "".join(f"line of text {k}\n" for k in range(900)), "h1"), (*row, "short text here", "h2")], schema)
    index.write_batch("0", new, HashingEmbedder(DIM))
    index.resplit(HashingEmbedder(DIM), 8000)
    texts = [r.text for r in index.chunks().collect()]
    assert "short text here" in texts and max(map(len, texts)) <= 2200 and len(texts) > 5
    index.resplit(HashingEmbedder(DIM), 100)  # a threshold below the limit loses nothing
    assert sorted(r.text for r in index.chunks().collect()) == sorted(texts)
    index.reset()
    assert index.chunks().count() == 0


def test_stored_postings_follow_the_batches(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    schema = "kind string, frame_start long, frame_end long, ts_start string, ts_end string, app string, window string, url string, n_frames int, piece_no int, src_hashes array<long>, text string, chunk_hash string"
    rows = lambda *texts: spark.createDataFrame([("screen", 1, 1, "t", "t", "a", "w", None, 1, 0, [], t, t[:20]) for t in texts], schema)
    scores = lambda f, x, q: {r.id: round(r.bm25, 9) for r in f(x, q).collect()}
    same = lambda q: scores(search.bm25_postings, index.postings(), q) == scores(search.bm25, index.chunks(), q) != {}
    index.write_batch("0", rows("red roses by the sea", "a ship at sea"), HashingEmbedder(DIM))
    index.write_batch("1", rows("the red ship", "long " + "line of red text\n" * 900), HashingEmbedder(DIM))
    assert same("sea red-ship") and same("red")
    index.write_batch("1", rows("the blue ship"), HashingEmbedder(DIM))  # a replay with other rows
    assert same("ship blue") and not scores(search.bm25_postings, index.postings(), "text")
    index.write_batch("2", rows("long " + "line of red text\n" * 900), HashingEmbedder(DIM))
    index.resplit(HashingEmbedder(DIM))
    assert same("red-text ship")
    plan = search.bm25_postings(index.postings(), "sea")._jdf.queryExecution().toString()
    assert "text" not in plan and "EqualTo(token,sea)" in plan
    index._unpost(index.version(), "kept")  # as in an index of an earlier version
    assert index.postings() is None and index.post_all() == ["kept"] and same("red-text ship")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "c.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE frames (id INTEGER PRIMARY KEY, app TEXT, score REAL)")
    db.executemany("INSERT INTO frames VALUES (?, ?, ?)", [(k, None if k % 3 else f"a{k}", k / 2) for k in range(100)])
    db.commit()
    df = read_sqlite(spark, path, "frames", 4)
    assert df.where("id > 90").count() == 9
    assert df.where("app IS NOT NULL AND id < 10").agg(F.sum("score")).first()[0] == 9.0
    assert df.where(F.col("id").isin(3, 5)).orderBy("id").collect()[1].score == 2.5


def test_command_line(spark, tmp_path):
    source = str(tmp_path / "src")
    frames(spark, range(12)).coalesce(1).write.parquet(source)
    base = ["--index", str(tmp_path / "idx")]
    counts = json.loads(cli.main([*base, "embed", "--frames", source, "--checkpoint", str(tmp_path / "cp")], spark))
    assert counts["screen"] > 0
    found = json.loads(cli.main([*base, "search", "frame 3", "-k", "2", "--json"], spark))
    assert len(found) == min(2, counts["screen"]) and set(found[0]) == {"score", "kind", "ts", "app", "window", "url", "n_frames", "snippet"}
    assert "Query" in cli.main([*base, "search", "frame"], spark)
    assert json.loads(cli.main([*base, "status"], spark)) == counts


def test_http_embedder_tries_again():
    tried = []

    class Flaky(HttpEmbedder):
        pass

    e = Flaky("http://127.0.0.1:9", tries=2, pause=0, timeout=0.2)
    with pytest.raises(RuntimeError, match="after 2 tries"):
        e(["x"])
    assert not e.alive() and not tried


def test_ids_are_consecutive_when_rows_come_out_otherwise_a_second_time(spark):
    """The ranges of a sort are cut by a sample, so that a second sort may cut them elsewhere; here the rows differ as well."""
    drawn = F.udf(lambda _: os.urandom(12).hex()).asNondeterministic()
    got = index.allocate_ids(spark.range(2000).repartition(7).select(drawn("id").alias("chunk_hash")), spark.range(42)).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.chunk_hash)] == list(range(42, 2042))
