"""WARC archives: written by Spark, read back and assembled into captures.

Every page becomes three records: the request, the response (or a revisit of an equal payload) and
metadata, which name the response's record in WARC-Concurrent-To. Tasks gather records until an archive is full by
bytes; an archive is one row of text and one file, whose line separator is the end mark of a WARC record, so Spark's
own writer commits the archives to any store. The reader cuts files by Content-Length, and the records of a capture meet in one join.

Edge cases: a null payload counts as an empty one and is still a capture; equal payloads below
``least`` bytes are all responses; rows that repeat an id and its payload are one capture, rows that
repeat an id alone are captures of their own; a page without an id is always a response; an empty table
writes no archive that holds a record; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist, scratch_dir
from .graph import join_hot

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive before compression: only one that holds a single record can be larger. A writer holds one archive,
#: a reader one as it is stored, and the records of one batch.
ARCHIVE, BATCH = 32 << 20, 8 << 20
HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To")
RECORD = "type string, id string, concurrent_to string, uri string, digest string, refers_to string, http string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Forty bits at a time: eight digits of base 32 in the RFC 4648 alphabet."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, page_id: Column, same: Column) -> Column:
    """A stable identifier of a page and its payload's hash, in the form of a UUID."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), same))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, an empty line and the block, as bytes."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    length = F.octet_length(block).cast("string")
    head = F.concat(*lines, F.lit("Content-Length: "), length, F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), block)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, record) with three records a page; ``pages`` has page_id, url and payload (bytes)."""
    found = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    found = found.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    # One row a payload of several pages; a payload of a third of all pages is dealt to many tasks.
    firsts = found.where(F.col("size") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = persist(firsts.where("n > 1"), "firsts")
    found = join_hot(found, firsts.select("same", "first"), "same", "left", firsts.select("same", "n")).withColumn("first", F.coalesce("first", "page_id"))
    revisit = F.col("first") != F.col("page_id")
    page, url, same = F.col("page_id"), F.col("url"), F.col("same")
    response = record_id("response", page, same)
    date = ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    target = ("WARC-Target-URI", url)
    http = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    common = [("WARC-Record-ID", response), date, target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http;msgtype=response"))]
    full = _record([("WARC-Type", F.lit("response")), *common], F.concat(http, F.col("payload")))
    again = _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("response", F.col("first"), same))], http)
    side = lambda kind, content: [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id(kind, page, same)), date, target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit(content))]
    request = _record(side("request", "application/http;msgtype=request"), F.encode(F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")), "UTF-8"))
    metadata = _record(side("metadata", "application/warc-fields"), F.encode(F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n")), "UTF-8"))
    rows = F.array(request, F.when(revisit, again).otherwise(full), metadata)
    return found.select("page_id", F.explode(rows).alias("record"))


def archives(rows: DataFrame, most: int = ARCHIVE) -> DataFrame:
    """(value): records in the order in which they come, joined by their end mark, at most so many bytes a row unless one record has more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for record in batch.column("record"):
                block = record.as_py()
                if held and size + len(block) > most:
                    yield full()
                    held, size = [], 0
                held.append(block)
                size += len(block) + len(END)
        if held:
            yield full()

    return rows.select("record").mapInArrow(gather, "value binary")


def write_archives(rows: DataFrame, path: str, most: int = ARCHIVE) -> None:
    """Whole-file gzip, a file an archive."""
    text = archives(rows, most).select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def parse(archive: BinaryIO) -> Iterator[tuple]:
    """Records of one archive, in the columns of ``RECORD``; one at a time is in memory."""
    while True:
        head = b""
        while not head.endswith(END.encode()):
            line = archive.readline()
            if not line:
                if head.strip():
                    raise ValueError("an archive ends within a record's head")
                return
            head = head + line if head.strip() else line
        fields = _headers(head[: -len(END)])
        block = archive.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or archive.read(4) != END.encode():
            raise ValueError("an archive ends within a record")
        http, _, payload = block.partition(END.encode())
        kind, ident, concurrent, uri, digest, refers = (fields.get(h) for h in HEADERS)
        yield (kind, ident, concurrent, uri, digest and digest.removeprefix("sha1:"), refers, http.decode(errors="replace"), payload if kind == "response" else None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives, with the size and the digest of each payload."""
    schema = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.string()) for c in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                raw, size = io.BytesIO(content.as_py()), 0
                for row in parse(gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BATCH:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()
                    rows = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})


def captures(found: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with the request and the metadata.

    The side records come in groups of two a capture at most, by the response that they name. ``found`` may
    lack the payload.
    """
    main = found.where(F.col("type").isin("response", "revisit"))
    side = found.where(F.col("concurrent_to").isNotNull()).select("type", "id", "uri", "http", "concurrent_to")
    pick = lambda kind: F.max(F.when(F.col("type") == kind, F.struct("id", "uri", "http"))).alias(kind)
    sides = side.groupBy("concurrent_to").agg(pick("request"), pick("metadata"))
    answer = F.struct("id", "type", *(c for c in found.columns if c not in ("id", "type", "concurrent_to"))).alias("response")
    return main.select(answer, F.col("id").alias("concurrent_to")).join(sides, "concurrent_to", "left").drop("concurrent_to")


def summary(found: DataFrame) -> DataFrame:
    """Digests of the payload of every capture; a revisit's are those of the record it refers to.

    Only the digests pass the joins: the optimizer prunes the payloads below them.
    """
    rows = found.select(
        F.regexp_extract("metadata.http", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.id").alias("id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    )
    # Read twice below, and far smaller than the archives; rows that repeat an id are one capture.
    one = rows.groupBy("id").agg(F.max(F.struct("payload_bytes", "payload_digest", "page_id", "record_type", "target")).alias("r"))
    rows = persist(one.select("id", "r.*"), "captures")
    originals = rows.where("record_type = 'response'").select(F.col("id").alias("target"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    joined = join_hot(rows, originals, "target", "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", F.col("original").alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Writes the archives to the shared folder, reads them back once and sums up each capture."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(records(pages, least), path, ARCHIVE)
    return summary(captures(persist(read_archives(spark, path).drop("payload"), "records")))
