"""Scratch tables leave the session as they found it."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common


def test_persist(spark):
    before = spark.conf.get(common.SHUFFLES_END, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    written = common.persist(rows, "sevens")
    assert sorted(written.collect()) == sorted(rows.collect())
    assert sorted(common.persist(rows, "again").collect()) == sorted(rows.collect())
    assert spark.conf.get(common.SHUFFLES_END, None) == before
    with pytest.raises(Exception):
        common.persist(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "fails")
    assert spark.conf.get(common.SHUFFLES_END, None) == before
    common.drop_scratch(spark, written)
