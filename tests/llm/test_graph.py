"""Connected components: nothing, loops, repeated edges, and a long path."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.graph import components, join_hot


def found(spark, edges):
    return {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_nothing_and_loops(spark):
    assert found(spark, []) == {}
    assert found(spark, [(3, 3), (4, 4)]) == {}
    assert found(spark, [(3, 3), (5, 3), (3, 5), (5, 3)]) == {3: 3, 5: 3}


def test_a_long_path_and_a_star(spark):
    names = list(range(100, 300))
    random.Random(3).shuffle(names)
    path = list(zip(names, names[1:], strict=False))
    star = [(7, k) for k in range(8, 40)]
    assert found(spark, path + star) == dict.fromkeys(names, 100) | dict.fromkeys(range(7, 40), 7)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_and_null_keys(spark, how):
    rows = [(k % 3 and k % 3000, k) for k in range(9000)] + [(None, k) for k in range(4000)] + [(7, 1)] * 3
    few = [(k, f"v{k}") for k in range(0, 2900)]
    a, b = spark.createDataFrame(rows, "key long, n long"), spark.createDataFrame(few, "key long, v string")
    got = Counter(map(tuple, join_hot(a, b, "key", how).select("key", "n", "v").collect()))
    named = dict(few)
    assert got == Counter((k, n, named.get(k)) for k, n in rows if how == "left" or k in named)


def test_a_hot_key_meets_in_many_tasks(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), "id")
    few = spark.range(30_000).select(F.col("id").alias("key"), (F.col("id") + 1).alias("v"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = join_hot(rows, few, "key").where("key = 0 OR key < 0").select(F.spark_partition_id().alias("t"), "v").distinct().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) > 1 and {r.v for r in tasks} == {1}


def test_join_of_an_empty_table(spark):
    a, b = spark.createDataFrame([], "key long, n long"), spark.createDataFrame([(1, "x")], "key long, v string")
    assert join_hot(a, b, "key", "left").collect() == []
