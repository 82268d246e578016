"""From a recorder's SQLite file to search results; hashes, attribution, state, and the single writer."""

import json
import re
import shutil
import sqlite3

import pytest

from palimpsest import cli
from palimpsest.functions.embedding import HashingEmbedder
from palimpsest.operators import attribution, blocks, known, search
from palimpsest.operators.index import Busy, Fenced, Index, WrongEmbedder
from palimpsest.streaming import ingest

DIM = 16
ROW = "stream_key long, id long, timestamp string, app string, window string, url string, text string, content_hash long"
CHUNK = "kind string, chunk_hash string, text string, src_hashes array<long>, frame_start long, frame_end long, ts_start string, ts_end string, app string, window string, url string, n_frames int, piece_no int"


def recorder(path, frames, events):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE frames (id INTEGER PRIMARY KEY, timestamp TEXT, app_name TEXT, window_name TEXT, browser_url TEXT, content_hash INTEGER, accessibility_text TEXT)")
    db.execute("CREATE TABLE ocr_text (frame_id INTEGER, text TEXT)")
    db.execute("CREATE TABLE ui_events (id INTEGER PRIMARY KEY, timestamp TEXT, event_type TEXT, text_content TEXT, app_name TEXT, window_title TEXT, browser_url TEXT, frame_id INTEGER)")
    db.executemany("INSERT INTO frames VALUES (?, ?, ?, ?, ?, ?, ?)", [f[:7] for f in frames])
    db.executemany("INSERT INTO ocr_text VALUES (?, ?)", [(f[0], t) for f in frames for t in f[7]])
    db.executemany("INSERT INTO ui_events VALUES (?, ?, ?, ?, ?, ?, ?, ?)", events)
    db.commit()
    return db


FRAMES = [
    (1, "2024-01-01T10:00:00", "editor", "notes", None, 11, "a chapter about gardens and roses", []),
    (2, "2024-01-01T10:01:00", "browser", "page", "https://a.example/", None, None, ["recognised words about harbours", "more recognised words about boats"]),
    (3, "2024-01-01T10:02:00", "browser", "page", "https://a.example/", (1 << 62) + 1, "a page about windmills by the sea", []),
    (4, "2024-01-01T10:03:00", "editor", "notes", None, None, "a later chapter about mountains", []),
]
EVENTS = [
    (1, "2024-01-01T10:01:10", "text", "typed words on sailing", None, None, None, None),
    (2, "not a time", "text", "words at no known time", "", None, None, None),
    (3, "2024-01-01T10:03:05", "click", "no typed words at all", None, None, None, None),
]


def test_a_recorder_file_becomes_searchable(spark, tmp_path):
    path = str(tmp_path / "memory.db")
    db = recorder(path, FRAMES, EVENTS)
    base = ["--index", str(tmp_path / "idx")]
    counts = json.loads(cli.main([*base, "embed", "--database", path, "--max-frames", "2"], spark))
    index = Index(spark, str(tmp_path / "idx"))
    assert index.state() | {"ended": None, "start": None} == {"last_frame_id": 2, "last_ui_event_id": 3, "chunks": 4, "runs": 1, "last_run": "2024-01-01T10:01:00", "start": None, "ended": None}
    assert counts == {"screen": 2, "typed": 2}
    typed = {r.text: r.app for r in index.chunks().where("kind = 'typed'").collect()}
    assert typed == {"typed zords on sqiling": "browser", "zords qt no knozn ti,e": None}
    found = json.loads(cli.main([*base, "search", "harbours", "-k", "1", "--json"], spark))
    assert "harbours" in found[0]["snippet"] and "boats" in found[0]["snippet"]
    assert "(vec=4 + fts=1)" in cli.main([*base, "search", "harbours"], spark)
    cli.main([*base, "embed", "--database", path], spark)
    assert index.state()["last_frame_id"] == 4 and index.state()["runs"] == 2
    assert {r.content_hash for r in index.seen_hashes().collect()} == {11, (1 << 62) + 1}
    before = index.chunks().count()
    cli.main([*base, "embed", "--database", path], spark)
    assert index.chunks().count() == before
    db.execute("INSERT INTO frames VALUES (5, '2024-01-01T11:00:00', 'editor', 'notes', NULL, 13, 'a new chapter about rivers and lakes')")
    db.commit()
    assert json.loads(cli.main([*base, "embed", "--database", path, "--safety-lag", "1"], spark))["screen"] == json.loads(cli.main([*base, "status"], spark))["screen"]
    assert index.state()["last_frame_id"] == 4
    cli.main([*base, "embed", "--database", path], spark)
    assert json.loads(cli.main([*base, "search", "rivers", "-k", "1", "--json"], spark))[0]["app"] == "editor"
    assert json.loads(cli.main([*base, "status", "--database", path], spark))["frames"] == 5
    record = json.loads(cli.main([*base, "health", "--database", path, "--history", str(tmp_path / "history"), "--now", "2024-01-01 11:01:00", "--service", "down"], spark))
    assert (record["status"], record["frames_total"], record["rag_watermark"], record["ui_text_24h"]) == ("degraded", 5, 5, 1) and record["disk_free_gb"] > 0
    merged = json.loads(cli.main([*base, "compact", "--expire-after", "0"], spark))
    assert merged["merged"] and len(merged["deleted"]) == 1 and index.chunks().count() == index.state()["chunks"]
    assert json.loads(cli.main([*base, "search", "rivers", "-k", "1", "--json"], spark))[0]["app"] == "editor"
    with pytest.raises(WrongEmbedder):
        cli.main(["--model-host", "http://127.0.0.1:9", *base, "search", "rivers"], spark)


def test_large_hashes_beside_nulls(spark):
    big = 4611686018427387905
    rows = [(0, 1, "t", "a", "w", None, "some text here", big), (0, 2, "t", "a", "w", None, "more text here", None), (0, 3, "t", "a", "w", None, "last text here", -big)]
    assert blocks.session_blocks(spark.createDataFrame(rows, ROW)).first().src_hashes == [big, -big]


def test_hashes_of_known_chunks_become_known(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    chunk = lambda h: spark.createDataFrame([("screen", "same", "the same text", [h], 1, 1, "t", "t", "a", "w", None, 1, 0)], CHUNK)
    assert index.write_batch("1", chunk(11), HashingEmbedder(DIM)) == 1
    assert index.write_batch("2", chunk(22), HashingEmbedder(DIM)) == 0
    assert {r.content_hash for r in index.seen_hashes().collect()} == {11, 22}
    assert {r.content_hash for r in index.seen_hashes("2").collect()} == {11}
    index.resplit(HashingEmbedder(DIM))
    assert {r.content_hash for r in index.seen_hashes().collect()} == {11, 22} and index.chunks().count() == 1


def test_attribution_keeps_to_its_stream_and_stands_odd_times(spark):
    frames = spark.createDataFrame([(1, "2024-01-01T00:00:00", "mine", "w", None, 7), (2, "2024-01-01T00:00:09", "theirs", "w", None, 8), (3, "yesterday", "x", "w", None, 7)], "id long, timestamp string, app_name string, window_name string, browser_url string, stream_key long")
    events = spark.createDataFrame([(1, "2024-01-01T00:00:10", None, None, None, 7), (2, "soon", None, None, None, 7)], "id long, timestamp string, app string, window string, url string, stream_key long")
    got = {r.id: r.app for r in attribution.attribute(events, frames, stream="stream_key").collect()}
    assert got == {1: "mine", 2: None}
    assert {r.id: r.app for r in attribution.attribute(events, frames).collect()} == {1: "theirs", 2: None}


def test_one_writer_and_pointers_that_only_grow(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    with index.writing():
        with pytest.raises(Busy), Index(spark, str(tmp_path / "idx")).writing():
            pass
        assert "skipped" in cli.main(["--index", str(tmp_path / "idx"), "embed", "--database", "none.db"], spark)
    with index.writing():
        first = index.reset()
    assert index.version() == first
    (tmp_path / "idx" / "pointers" / "000000000099").write_text("half")  # a writer that died while writing
    assert index.version() == first
    index._create("pointers/000000000100", "v-new")
    with pytest.raises(Exception, match="000000000100"):
        index._create("pointers/000000000100", "v-other")
    assert index.version() == "v-new"


def test_a_failed_run_is_repeated(spark, tmp_path):
    path = str(tmp_path / "memory.db")
    recorder(path, FRAMES, EVENTS)
    index, calls = Index(spark, str(tmp_path / "idx")), []
    save = index.save_state
    index.save_state = lambda state: calls.append(state) or (_ for _ in ()).throw(RuntimeError("killed"))
    index.point_to("v-1")
    with pytest.raises(RuntimeError, match="killed"):
        ingest.ingest_database(spark, path, index, HashingEmbedder(DIM))
    assert index.state()["last_frame_id"] == 0 and index.chunks().count() > 0
    index.save_state = save
    ingest.ingest_database(spark, path, index, HashingEmbedder(DIM), say=calls.append)
    hashes = [r.chunk_hash for r in index.chunks().collect()]
    assert len(hashes) == len(set(hashes)) and {"screen", "typed"} == {r.kind for r in index.chunks().collect()}
    assert any("screen" in str(c) for c in calls)


def chunk(spark, *texts, hashes=()):
    rows = [("screen", f"h {t}"[:24], t, list(hashes), 1, 1, "t", "t", "a", "w", None, 1, 0) for t in texts]
    return spark.createDataFrame(rows, CHUNK)


def test_a_batch_reads_what_may_hold_its_keys_and_no_text(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    for k in range(6):
        index.write_batch(str(k), chunk(spark, *(f"text {k} {j}" for j in range(20)), hashes=range(100 * k, 100 * k + 20)), HashingEmbedder(DIM))
    asked = spark.createDataFrame([("h text 3 7"[:24],), ("h text 9 9"[:24],), (None,)], "chunk_hash string")
    found = index.among("chunks", asked)
    assert [r.chunk_hash for r in found.collect()] == ["h text 3 7"]
    plan = found._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "text" not in plan and "embedding" not in plan and re.search(r"PartitionFilters: \[[^]]*batch#\d+ = 3", plan)
    for path in (tmp_path / "idx" / index.version() / "known_chunks").glob("batch=[!3]/*/*.parquet"):
        path.write_bytes(b"never read")
    assert [r.chunk_hash for r in index.among("chunks", asked).collect()] == ["h text 3 7"]
    assert index.among("chunks", asked, but="3").collect() == []
    assert sorted(r[0] for r in index.among("content", spark.range(0, 700, 7)).collect()) == [k for k in range(0, 700, 7) if k < 600 and k % 100 < 20]
    # what an index of an earlier version lacks is added
    for name in ("known_chunks", "filters_chunks", "filters_content"):
        shutil.rmtree(tmp_path / "idx" / index.version() / name / "batch=3")
    assert index.among("chunks", asked).collect() == [] and index.complete() == ["content 3", "chunks 3"]
    assert index.among("chunks", asked).count() == 1


def test_filters_hold_all_keys_and_few_others(spark):
    keys = spark.range(50_000).selectExpr("id AS content_hash")
    filters = known.bloom(keys, 50_000).selectExpr("*", "'b' AS batch").persist()
    assert filters.select("blocks").distinct().collect() == [(128,)]
    assert known.may_hold(keys, filters).count() == 50_000
    assert known.may_hold(spark.range(1_000_000, 1_050_000).selectExpr("id AS content_hash"), filters).count() < 1500


def test_a_writer_that_slept_past_its_lease_cannot_write(spark, tmp_path):
    slow, quick = Index(spark, str(tmp_path / "idx")), Index(spark, str(tmp_path / "idx"))
    with slow.writing(term=0.0):
        slow.reset()
        slow.term = 0.0
        slow._may_write()
        with quick.writing():
            quick.write_batch("1", chunk(spark, "words of the second writer"), HashingEmbedder(DIM))
            with pytest.raises(Fenced):
                slow.write_batch("2", chunk(spark, "words of the first writer"), HashingEmbedder(DIM))
            with pytest.raises(Fenced):
                slow.save_state({})
            quick.save_state({"runs": 7})
    assert [r.text for r in quick.chunks().collect()] == ["words of the second writer"] and quick.state()["runs"] == 7
    with slow.writing():
        quick.unlock()
        with pytest.raises(Fenced):
            slow.save_state({})
        with quick.writing():
            pass


def test_compaction_of_many_batches(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    for k in range(12):
        index.write_batch(str(k), chunk(spark, f"words number{k} of a batch", hashes=[k]), HashingEmbedder(DIM))
    assert index.last == {"new": 1, "screen": 1, "typed": 0, "skipped": 0}
    recount = {r.batch: r["count"] for r in index.chunks().groupBy("batch").count().collect()}
    assert {r.batch: r.new for r in index.metrics().collect()} == recount and index.metrics().where("skipped > 0 OR seconds <= 0").count() == 0
    before, old = index.chunks().select("id", "text").orderBy("id").collect(), index.version()
    held = index.chunks()
    seek = lambda: [(r.id, round(r.bm25, 9)) for r in search.bm25_postings(index.postings(), "number7 batch").orderBy("id").collect()]
    found = seek()
    assert index.compact() and len(index.batches()) == 1 and index.version() != old
    assert held.count() == 12  # a reader of the old version goes on
    assert index.chunks().select("id", "text").orderBy("id").collect() == before and seek() == found
    assert {r.content_hash for r in index.seen_hashes().collect()} == set(range(12))
    assert index.write_batch("3", chunk(spark, "words number3 of a batch", hashes=[3]), HashingEmbedder(DIM)) == 0 and index.last["skipped"] == 1
    assert index.expire(3600) == [] and index.expire(0) == [old] and index.compact(3) is None


def test_text_that_comes_a_run_later(spark, tmp_path):
    path = str(tmp_path / "memory.db")
    db = recorder(path, [*FRAMES, (5, "2024-01-01T10:04:00", "viewer", "scan", None, 77, None, []), (6, "2024-01-01T10:05:00", "viewer", "scan", None, None, "short", [])], [])
    index = Index(spark, str(tmp_path / "idx"))
    run = lambda **more: ingest.ingest_database(spark, path, index, HashingEmbedder(DIM), say=lambda _: None, **more)
    run()
    texts = lambda: sorted(r.text for r in index.chunks().collect())
    first = texts()
    run(rewind=100)
    assert texts() == first
    db.execute("INSERT INTO ocr_text VALUES (5, 'scanned words about lighthouses')")
    db.commit()
    run()
    assert texts() == first
    for _ in range(2):
        run(rewind=100)
        assert texts() == sorted([*first, "scanned words about lighthouses"])


def test_the_recorder_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "memory.db")
    db = recorder(path, FRAMES, EVENTS)
    index, batch = Index(spark, str(tmp_path / "a")), Index(spark, str(tmp_path / "b"))
    run = lambda: ingest.stream_database(spark, path, index, str(tmp_path / "cp"), HashingEmbedder(DIM), 2)
    texts = lambda i: sorted(r.text for r in i.chunks().collect())
    run()
    ingest.ingest_database(spark, path, batch, HashingEmbedder(DIM), say=lambda _: None)
    assert texts(index) == texts(batch)
    write = index.write_batch
    index.write_batch = lambda *a: write(*a) and None or (_ for _ in ()).throw(RuntimeError("killed after the write"))
    db.execute("INSERT INTO frames VALUES (9, '2024-01-01T11:00:00', 'editor', 'notes', NULL, 13, 'a new chapter about rivers and lakes')")
    db.commit()
    with pytest.raises(Exception, match="killed"):
        run()
    index.write_batch = write
    run()
    run()
    assert texts(index) == sorted([*texts(batch), "a new chapter about rivers and lakes"])
