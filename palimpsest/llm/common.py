"""Helpers shared by the corpus operators: table access, scratch tables, column sugar."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder.

    Where none is configured, a local session (tests, a laptop) gets a temporary folder once; on a cluster, where
    executors could not read it, that is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        where = sc.getCheckpointDir()
    return where


#: With this setting Spark deletes the shuffles of an execution as soon as it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage: a lost executor re-reads a file instead of recomputing. The shuffles of the write
    serve nothing else and are deleted when it is done.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that ``persist`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver find shuffles that nothing uses any more, whose files executors then delete.

    Spark deletes them when their plans are collected, which may be long after the last use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row even if the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
