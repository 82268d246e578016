"""Command line: embed, search, resplit, compact, health, status."""

from __future__ import annotations

import argparse
import json
import os
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import Embedder, HashingEmbedder, HttpEmbedder
from .operators import health, search
from .operators.index import Busy, Index
from .sources.sqlite import read_sqlite
from .streaming import ingest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--index", required=True, help="folder of the index")
    top.add_argument("--model-host", help="address of the embedding server; without it, hashed words are the vectors")
    sub = top.add_subparsers(dest="command", required=True)
    embed = sub.add_parser("embed")
    embed.add_argument("--database", help="a recorder's SQLite file"), embed.add_argument("--max-frames", type=int, default=0), embed.add_argument("--safety-lag", type=int, default=0)
    embed.add_argument("--partitions", type=int, default=1, help="tasks that read a table of the file"), embed.add_argument("--rewind", type=int, default=0, help="frames read again for text that came late")
    embed.add_argument("--frames"), embed.add_argument("--typed"), embed.add_argument("--checkpoint", help="for folders of Parquet files")
    embed.add_argument("--unlock", action="store_true", help="remove the mark of a writer that died")
    embed.add_argument("--max-files", type=int, default=1000)
    embed.add_argument("--reset", action="store_true")
    embed.add_argument("--only-typed", action="store_true"), embed.add_argument("--skip-typed", action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query"), find.add_argument("-k", type=int, default=search.TOP)
    find.add_argument("--kind", choices=["screen", "typed"]), find.add_argument("--json", action="store_true")
    sub.add_parser("resplit").add_argument("--threshold", type=int, default=8000)
    tidy = sub.add_parser("compact")
    tidy.add_argument("--least", type=int, default=2, help="batches from which on they are merged"), tidy.add_argument("--expire-after", type=float, help="seconds after which old versions are deleted")
    snap = sub.add_parser("health")
    snap.add_argument("--history", required=True), snap.add_argument("--now", help="the time now, if none is given")
    snap.add_argument("--database", help="a recorder's SQLite file"), snap.add_argument("--data", help="the recorder's folder, to be measured")
    for name in ("--frames", "--ocr", "--typed"):
        snap.add_argument(name, help="a Parquet table, in place of the file")
    snap.add_argument("--service", choices=["up", "down"], default="up", help="whether the recorder runs, as a probe of it says")
    status = sub.add_parser("status")
    status.add_argument("--database", help="a recorder's SQLite file, whose totals are added")
    return top


#: The recorder's tables.
TABLES = ("frames", "ocr_text", "ui_events")


def _megabytes(path: str | None) -> int:
    if not path or not os.path.exists(path):
        return 0
    files = [path] if os.path.isfile(path) else [f for f in Path(path).rglob("*") if f.is_file()]
    return sum(os.path.getsize(f) for f in files) >> 20


def _health(a: argparse.Namespace, spark: SparkSession, index: Index) -> DataFrame:
    """The day's record, with the sizes of the recorder's file, its folder and the free disk around it."""
    if a.database:
        frames, texts, events = (read_sqlite(spark, a.database, name) for name in TABLES)
        home = a.data or os.path.dirname(os.path.abspath(a.database))
        sizes = {"db_mb": _megabytes(a.database), "data_mb": _megabytes(home), "disk_free_gb": shutil.disk_usage(home).free >> 30}
    else:
        frames, texts, events = (spark.read.parquet(p) for p in (a.frames, a.ocr, a.typed))
        sizes = {}
    now = a.now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return health.snapshot(frames, texts, events, index.chunks(), now, index.state()["last_frame_id"], a.service == "up", **sizes)


def _embed(a: argparse.Namespace, spark: SparkSession, index: Index, embedder: Embedder) -> None:
    """One run. Offsets of files belong to a start from nothing: a resplit keeps them."""
    if a.reset or index.version() is None:
        index.save_state(index.state() | {"start": index.reset()})
    start = f"{a.checkpoint}/{index.state()['start']}"
    if a.frames and not a.only_typed:
        ingest.ingest_frames(spark, a.frames, index, f"{start}/screen", embedder, files_per_batch=a.max_files)
    if a.typed and not a.skip_typed:
        ingest.ingest_typed(spark, a.typed, index, f"{start}/typed", embedder, files_per_batch=a.max_files)
    if a.database:
        ingest.ingest_database(spark, a.database, index, embedder, a.max_frames, not a.skip_typed, not a.only_typed, a.safety_lag, a.partitions, rewind=a.rewind)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    embedder = HttpEmbedder(a.model_host) if a.model_host else HashingEmbedder()
    index = Index(spark, a.index)
    if a.command == "embed":
        if isinstance(embedder, HttpEmbedder) and not embedder.alive():
            return "the model server does not answer; nothing was read"
        if (a.frames or a.typed) and not a.checkpoint:
            return "files need a --checkpoint"
        if a.unlock:
            index.unlock()
        try:
            with index.writing():
                index.complete()
                index.post_all()
                _embed(a, spark, index, embedder)
        except Busy:
            return "another run writes to the index; this one was skipped"
    if a.command == "search":
        index.fits(embedder)
        vector = embedder([a.query])[0]
        chunks = index.chunks()
        vectors, postings = chunks.select("id", "embedding"), index.postings()
        near, said = (p.persist() for p in search.pools(chunks, vectors, a.query, vector, a.kind, max(search.POOL, a.k), postings))
        rows = search.best(chunks, near, said, a.k).drop("id").collect()
        if a.json:
            return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2)
        return search.as_text(rows, a.query, near.count(), said.count())
    if a.command == "resplit":
        try:
            with index.writing():
                index.resplit(embedder, a.threshold)
        except Busy:
            return "another run writes to the index; this one was skipped"
    if a.command == "compact":
        try:
            with index.writing():
                merged = index.compact(a.least)
                gone = index.expire(a.expire_after) if a.expire_after is not None else []
        except Busy:
            return "another run writes to the index; this one was skipped"
        return json.dumps({"version": merged or index.version(), "merged": bool(merged), "deleted": gone})
    if a.command == "health":
        record = _health(a, spark, index)
        health.append(record, a.history)
        return record.toJSON().first()
    counts = index.chunks().groupBy("kind").agg(F.count("*")).collect()
    found = dict(sorted((r[0], r[1]) for r in counts))
    if getattr(a, "database", None) and a.command == "status":
        found |= {name: read_sqlite(spark, a.database, name).count() for name in TABLES}
    return json.dumps(found)


if __name__ == "__main__":
    print(main())
