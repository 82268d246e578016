"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, and read again where an executor is lost."""
    path = f"{folder(df.sparkSession)}/memory/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_here, "paths", None) is not None:
        _here.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes at its end the tables that are written inside it; what reads them must be done by then."""
    outer, _here.paths = getattr(_here, "paths", None), []
    try:
        yield
    finally:
        paths, _here.paths = _here.paths, outer
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
