"""The index: batches of chunks on Parquet, replayable, in version folders.

    <root>/pointers/<number>              the name of a version; the greatest number is live
    <root>/<version>/chunks/batch=<id>/   chunks with their embeddings and source hashes
    <root>/<version>/postings/batch=<id>/ its inverted index, sorted by token and part; totals/batch=<id>/: number and length of its chunks;
                                          tops/batch=<id>/: what scores a token can give in a part
    <root>/<version>/known_content/batch=<id>/bucket=<n>/  content hashes of the whole batch, of chunks that were known too
    <root>/<version>/known_chunks/batch=<id>/bucket=<n>/   chunk hashes; filters_<set>/batch=<id>/: what either set may hold (see ``known``)
    <root>/<version>/embedder             the model and length of its vectors
    <root>/waiting/, <root>/late/batch=<id>/  frames that had no text when they were read, and those whose text came late
    <root>/metrics/<batch>.json           what a batch's write counted, observed while it was written
    <root>/states/<number>                watermarks and counts of the runs; the greatest number holds
    <root>/leases/<number>                who may write, and until when; the greatest number holds

A batch is written whole and overwrites itself when replayed. Pointers, states and leases are new files that
nothing replaces: a reader sees the old or the new one, and of two writers of one number the second fails. A writer
whose lease is not the greatest any more, because it slept past its end or was unlocked, can write nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import DIM, Embedder, embed
from ..functions.text import chunk_hash, split_text
from ..schema import schema
from . import known
from .ordered import dealt
from .scratch import written
from .search import Postings, in_ranges, postings_of, tops_of

CHUNKS = schema(
    "id long, kind string, chunk_hash string, frame_start long, frame_end long, ts_start string, ts_end string, app string, "
    "window string, url string, n_frames int, text string, piece_no int, src_hashes array<long>, embedding array<float>"
)
POSTINGS = schema("token string, id long, kind string, length int, positions array<int>, part int")
TOTALS = schema("chunks long, length long")
TOPS = schema("token string, part int, kind string, n long, most int, least int")
#: Bytes of a row group of postings: small, so that a search skips what it does not need.
ROW_GROUP = 1 << 20


#: The key of each permanent set.
SETS = {"content": "content_hash long", "chunks": "chunk_hash string"}
LEASE_S = 3600.0


class Busy(RuntimeError):
    """Another run writes to the index."""


class Fenced(RuntimeError):
    """Another writer has taken over; this one may not write any more."""


class WrongEmbedder(ValueError):
    """The index holds vectors of another model or length."""


class Index:
    def __init__(self, spark: SparkSession, root: str, dim: int = DIM) -> None:
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim
        self.lease: int | None = None
        self.term = LEASE_S
        #: Of the last batch: chunks by kind that were new, and how many were not.
        self.last: dict = {}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbered(self, folder: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _latest(self, folder: str) -> str | None:
        """What the file of the greatest number says; one that is being written says nothing yet."""
        for number in self._numbered(folder):
            fs, p = self._fs(f"{self.root}/{folder}/{number:012d}")
            source = fs.open(p)
            said = bytes(source.readAllBytes()).decode()
            source.close()
            if said.endswith("\n"):
                return said[:-1]
        return None

    def _put(self, folder: str, said: str) -> None:
        """Adds the file of the next number; fails if another writer has added it."""
        self._may_write()
        number = next(iter(self._numbered(folder)), 0) + 1
        self._create(f"{folder}/{number:012d}", said)

    def _create(self, name: str, said: str, replace: bool = False) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        sink = fs.create(p, replace)
        sink.write(f"{said}\n".encode())
        sink.close()

    def _lease(self, number: int, owner: str, until: float) -> None:
        fs, p = self._fs(f"{self.root}/leases/{number:012d}")
        sink = fs.create(p, number == self.lease)
        sink.write(f"{json.dumps({'owner': owner, 'until': until})}\n".encode())
        sink.close()

    @contextlib.contextmanager
    def writing(self, term: float = LEASE_S):
        """The single writer, for as long as its lease runs; each write extends it. A lease that has run out is taken over."""
        owner, self.term = f"{os.uname().nodename}-{os.getpid()}-{uuid.uuid4().hex}", term
        held = json.loads(self._latest("leases") or '{"until": 0}')
        if held["until"] > time.time():
            raise Busy(f"{held['owner']} writes to {self.root}")
        number = next(iter(self._numbered("leases")), 0) + 1
        try:
            self._lease(number, owner, time.time() + term)
        except Exception as error:  # the file system's own exception, through the gateway
            if number not in self._numbered("leases"):
                raise
            raise Busy(f"another writer was faster at {self.root}") from error
        self.lease = number
        try:
            yield self
        finally:
            if number == next(iter(self._numbered("leases")), 0):
                self._lease(number, owner, 0)
            self.lease = None

    def _may_write(self) -> None:
        """Called before every write. Without a lease (a caller that guards the index itself) all writes pass."""
        if self.lease is None:
            return
        if self.lease != next(iter(self._numbered("leases")), 0):
            raise Fenced(f"lease {self.lease} of {self.root} is not the last one")
        self._lease(self.lease, f"{os.uname().nodename}-{os.getpid()}", time.time() + self.term)

    def unlock(self) -> None:
        """Ends any lease: a new one that has run out already fences its holder."""
        self._lease(next(iter(self._numbered("leases")), 0) + 1, "unlocked", 0)

    def version(self) -> str | None:
        return self._latest("pointers")

    def point_to(self, version: str) -> None:
        """Names the live version."""
        self._put("pointers", version)

    def state(self) -> dict:
        """Watermarks, number of chunks and runs, and the time of the last run."""
        return {"last_frame_id": 0, "last_ui_event_id": 0, "chunks": 0, "runs": 0, "last_run": None} | json.loads(self._latest("states") or "{}")

    def save_state(self, state: dict) -> None:
        self._put("states", json.dumps(state))

    def reset(self) -> str:
        """A new, empty version; the next run reads from the start."""
        version = f"v-{uuid.uuid4().hex}"
        self.point_to(version)
        self.save_state(self.state() | {"last_frame_id": 0, "last_ui_event_id": 0, "chunks": 0})
        return version

    def _read(self, part: str, fields: T.StructType) -> DataFrame:
        whole = T.StructType([*fields.fields, T.StructField("batch", T.StringType())])
        path = f"{self.root}/{self.version()}/{part}"
        fs, p = self._fs(path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(path)

    def chunks(self) -> DataFrame:
        return migrated(self._read("chunks", CHUNKS))

    def _without_postings(self) -> set[str]:
        """Batches with chunks, whole or not, of which no whole postings are stored."""
        fs, chunks = self._fs(f"{self.root}/{self.version()}/chunks/batch=*")
        totals = self._fs(f"{self.root}/{self.version()}/tops/batch=*/_SUCCESS")[1]
        return {f.getPath().getName() for f in fs.globStatus(chunks) or []} - {f.getPath().getParent().getName() for f in fs.globStatus(totals) or []}

    def postings(self) -> Postings | None:
        """The inverted index; None while a batch lacks its own, as in an index of an earlier version."""
        if self._without_postings():
            return None
        return Postings(self._read("postings", POSTINGS), self._read("totals", TOTALS), self._read("tops", TOPS))

    def _post(self, version: str, batch: str) -> None:
        """Writes a batch's postings, from its stored chunks; the tops come last and say that it is whole."""
        named = postings_of(migrated(self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{version}/chunks/batch={batch}")))
        at = f"{self.root}/{version}/postings/batch={batch}"
        rows = in_ranges(written(named.rows, "unsorted")).select(*(F.col(f.name).cast(f.dataType) for f in POSTINGS.fields))
        rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(at)
        named.totals.write.mode("overwrite").parquet(f"{self.root}/{version}/totals/batch={batch}")
        tops = tops_of(self.spark.read.schema(POSTINGS).parquet(at)).repartitionByRange("token", "part").sortWithinPartitions("token", "part")
        tops.select(*(F.col(f.name).cast(f.dataType) for f in TOPS.fields)).write.mode("overwrite").parquet(f"{self.root}/{version}/tops/batch={batch}")

    def _unpost(self, version: str, batch: str) -> None:
        fs, p = self._fs(f"{self.root}/{version}/tops/batch={batch}")
        fs.delete(p, True)

    def post_all(self) -> list[str]:
        """Postings for batches that have none; returns their names."""
        lacking = sorted(name.removeprefix("batch=") for name in self._without_postings())
        for batch in lacking:
            self._post(self.version(), batch)
        return lacking

    def embedder(self) -> dict | None:
        """The model that the version's vectors come from, and their length."""
        fs, p = self._fs(f"{self.root}/{self.version()}/embedder")
        if not fs.exists(p):
            return None
        source = fs.open(p)
        said = bytes(source.readAllBytes()).decode()
        source.close()
        return json.loads(said)

    def fits(self, embedder: Embedder, version: str | None = None, record: bool = False) -> None:
        """An error if the vectors are another model's. The first writer of a version says whose they are."""
        own = getattr(embedder, "identity", None)
        there = self.embedder() if version in (None, self.version()) else None
        if own and there and own != there:
            raise WrongEmbedder(f"the index holds vectors of {there}, not of {own}")
        if own and record and not there:
            self._create(f"{version}/embedder", json.dumps(own))

    def _keep(self, version: str, name: str, keys: DataFrame, batch: str) -> None:
        """Writes a batch's set and its filter; the filter comes last and says that both are whole."""
        key = SETS[name].split()[0]
        fs, old = self._fs(f"{self.root}/{version}/filters_{name}/batch={batch}")
        fs.delete(old, True)
        at = f"{self.root}/{version}/known_{name}/batch={batch}"
        rows = keys.select(key).distinct().withColumn("bucket", known.bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(at)
        stored = self.spark.read.schema(schema(SETS[name])).parquet(at) if rows_in(fs, self._fs(at)[1]) else keys.select(key).limit(0)
        known.bloom(stored, stored.count()).coalesce(8).write.mode("overwrite").parquet(f"{self.root}/{version}/filters_{name}/batch={batch}")

    def _set(self, name: str) -> DataFrame:
        return self._read(f"known_{name}", schema(f"{SETS[name]}, bucket int"))

    def _filters(self, name: str) -> DataFrame:
        return self._read(f"filters_{name}", schema(known.FILTER))

    def among(self, name: str, keys: DataFrame, but: str = "") -> DataFrame:
        """Of the distinct ``keys`` (one column) those that another batch's set holds. Filters say which batches and buckets are read."""
        key = SETS[name].split()[0]
        asked = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        hits = known.may_hold(asked, self._filters(name).where(F.col("batch") != but))
        touched = hits.select("batch", known.bucket(key).alias("bucket")).distinct().collect()  # batches times buckets at most
        if not touched:
            return asked.limit(0)
        stored = self._set(name).where(F.col("batch").isin(sorted({r[0] for r in touched})) & F.col("bucket").isin(sorted({r[1] for r in touched})) & (F.col("batch") != but))
        return asked.join(stored.select(key), key, "left_semi")

    def complete(self) -> list[str]:
        """Sets and filters for batches that lack them: of an earlier version, or of a run that failed between. Their names."""
        version = self.version()
        fs, chunks = self._fs(f"{self.root}/{version}/chunks/batch=*")
        have = {f.getPath().getName().removeprefix("batch=") for f in fs.globStatus(chunks) or []}
        done = []
        for name in SETS:
            whole = self._fs(f"{self.root}/{version}/filters_{name}/batch=*/_SUCCESS")[1]
            for batch in sorted(have - {f.getPath().getParent().getName().removeprefix("batch=") for f in fs.globStatus(whole) or []}):
                rows = migrated(self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{version}/chunks/batch={batch}"))
                seen = f"{self.root}/{version}/seen/batch={batch}"
                if name == "content" and fs.exists(self._fs(seen)[1]):
                    keys = self.spark.read.schema(schema(SETS[name])).parquet(seen)
                else:
                    keys = rows.select("chunk_hash") if name == "chunks" else rows.select(F.explode("src_hashes").alias("content_hash"))
                self._keep(version, name, keys, batch)
                done.append(f"{name} {batch}")
        return done

    def write_batch(self, batch: str, new: DataFrame, embedder: Embedder) -> int:
        """Adds the chunks of ``new`` whose hash no other batch has, once each; returns how many.

        Ids are hashes of the chunk hash, so a replay gives the same. The content hashes of all of ``new`` become
        known, also those of chunks that another batch has already. What is counted (``last``) is observed as the batch is written.
        """
        self._may_write()
        began = time.time()
        version = self.version() or self.reset()
        self.fits(embedder, version, record=True)
        self.complete()
        new = new.persist()
        try:
            rows, added = Observation(), Observation()
            watched = new.observe(rows, F.count("*").alias("rows"))
            old = self.among("chunks", new.select("chunk_hash"), but=batch)
            fresh = watched.dropDuplicates(["chunk_hash"]).join(old, "chunk_hash", "left_anti")
            counted = fresh.observe(added, F.count("*").alias("new"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("screen", "typed")))
            named = embed(counted.withColumn("id", F.xxhash64("chunk_hash")), embedder)
            self._keep(version, "content", new.select(F.explode("src_hashes").alias("content_hash")), batch)
            self._unpost(version, batch)
            self._may_write()
            at = f"{self.root}/{version}/chunks/batch={batch}"
            named.select(*(F.col(f.name).cast(f.dataType) for f in CHUNKS.fields)).write.mode("overwrite").parquet(at)
            self._keep(version, "chunks", self.spark.read.schema(CHUNKS).parquet(at).select("chunk_hash"), batch)
            self._post(version, batch)
            self.last = added.get | {"skipped": rows.get["rows"] - added.get["new"]}
            self._create(f"metrics/{batch}.json", json.dumps(self.last | {"batch": batch, "version": version, "seconds": round(time.time() - began, 3)}), replace=True)
            return self.last["new"]
        finally:
            new.unpersist()

    def note(self, folder: str, batch: str, ids: DataFrame) -> None:
        """Writes the frame ids of a batch that wait for their text (``waiting``) or whose text came late (``late``)."""
        self._may_write()
        ids.select(F.col("id").cast("long")).distinct().write.mode("overwrite").parquet(f"{self.root}/{folder}/batch={batch}")

    def noted(self, folder: str) -> DataFrame:
        fs, p = self._fs(f"{self.root}/{folder}")
        whole = schema("id long, batch string")
        return self.spark.read.schema(whole).parquet(f"{self.root}/{folder}") if fs.exists(p) else self.spark.createDataFrame([], whole)

    def metrics(self) -> DataFrame:
        """(batch, version, new, skipped, screen, typed, seconds): one row a batch, of its last write."""
        fields = schema("batch string, version string, new long, skipped long, screen long, typed long, seconds double")
        fs, p = self._fs(f"{self.root}/metrics")
        return self.spark.read.schema(fields).json(f"{self.root}/metrics") if fs.exists(p) else self.spark.createDataFrame([], fields)

    def seen_hashes(self, but: str = "") -> DataFrame:
        """Content hashes of all batches but one: a batch that is replayed must not know itself."""
        return self._set("content").where(F.col("batch") != but).select("content_hash").distinct()

    def resplit(self, embedder: Embedder, threshold: int = 8000, limit: int = 2200) -> str:
        """A new version in which texts above the threshold are cut to the limit; the old one stays until then."""
        old = self.chunks()
        large = F.char_length("text") > F.greatest(F.lit(threshold), F.lit(limit))
        kept = old.where(~large)
        pieces = resplit_pieces(old.where(large), limit).join(kept.select("chunk_hash"), "chunk_hash", "left_anti").dropDuplicates(["chunk_hash"])
        named = embed(pieces.withColumn("id", F.xxhash64("chunk_hash")), embedder)
        parts = {"kept": kept.select(*CHUNKS.names), "resplit": named.select(*(F.col(f.name).cast(f.dataType) for f in CHUNKS.fields))}
        return self._rewritten(parts, embedder)

    def _rewritten(self, parts: dict[str, DataFrame], embedder: Embedder | None) -> str:
        """A new live version of these batches, with all content hashes of the old one."""
        self._may_write()
        version = f"v-{uuid.uuid4().hex}"
        content = self.seen_hashes()
        if embedder is not None:
            self.fits(embedder, version, record=True)
        elif self.embedder():
            self._create(f"{version}/embedder", json.dumps(self.embedder()))
        for k, (batch, rows) in enumerate(parts.items()):
            at = f"{self.root}/{version}/chunks/batch={batch}"
            rows.write.parquet(at)
            self._keep(version, "chunks", self.spark.read.schema(CHUNKS).parquet(at).select("chunk_hash"), batch)
            self._keep(version, "content", content if k == 0 else content.limit(0), batch)
            self._post(version, batch)
        self.point_to(version)
        return version

    def batches(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/{self.version()}/chunks/batch=*")
        return sorted(f.getPath().getName().removeprefix("batch=") for f in fs.globStatus(p) or [])

    def compact(self, least: int = 2) -> str | None:
        """Merges all batches into one, if there are ``least``: chunks sorted by kind and id, one set, one filter, one inverted index.

        Readers keep the old version until the pointer moves, and its files until ``expire``. A batch that is replayed
        afterwards finds its chunks known and adds nothing.
        """
        if len(self.batches()) < least:
            return None
        self.complete()
        rows = self.chunks().select(*CHUNKS.names)
        return self._rewritten({f"merged-{uuid.uuid4().hex[:8]}": rows.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id")}, None)

    def expire(self, age_s: float) -> list[str]:
        """Deletes versions other than the live one whose folder has not changed for so long; their names."""
        fs, p = self._fs(f"{self.root}/v-*")
        now, live = time.time() * 1000, self.version()
        old = [f.getPath() for f in fs.globStatus(p) or [] if f.getPath().getName() != live and now - f.getModificationTime() >= age_s * 1000]
        for path in old:
            self._may_write()
            fs.delete(path, True)
        return sorted(path.getName() for path in old)


def rows_in(fs, folder) -> bool:
    """Whether a partitioned table has any partition; one written from no rows has none."""
    return any("=" in f.getPath().getName() for f in fs.listStatus(folder))


def migrated(chunks: DataFrame) -> DataFrame:
    """Old rows get what later versions added: a kind, and a hash of kind and text."""
    kind = F.coalesce("kind", F.lit("screen")) if "kind" in chunks.columns else F.lit("screen")
    with_kind = chunks.withColumn("kind", kind)
    hashed = chunk_hash("kind", "text")
    return with_kind.withColumn("chunk_hash", F.coalesce("chunk_hash", hashed) if "chunk_hash" in chunks.columns else hashed)


def resplit_pieces(large: DataFrame, limit: int = 2200) -> DataFrame:
    cut = large.drop("piece_no").select("*", F.posexplode(split_text("text", limit)).alias("piece_no", "__p")).drop("text").withColumnRenamed("__p", "text")
    return cut.withColumn("chunk_hash", chunk_hash("kind", "text"))


def allocate_ids(new: DataFrame, existing: DataFrame, order: str = "chunk_hash") -> DataFrame:
    """Consecutive ids after the greatest existing one.

    The sorted rows are written before they are numbered: sorted a second time, their ranges may be cut elsewhere, and the
    partitions' sizes would be those of other ranges. No window over all rows is needed.
    """
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    return dealt(new, [order]).withColumn("id", F.col("pos") + start).drop("pos", "bucket")
