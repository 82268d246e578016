"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, persist

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours above a node, then those below it, move to the least one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one ordered type), root the least.

    Alternating stars: each round is a few joins and aggregates on the edges and is written to the
    shared folder; rounds grow with the logarithm of the longest path. Self-loops and repeated
    edges are ignored; an isolated node has no row.
    """
    a, b = edges.columns
    now = persist(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    spark = now.sparkSession
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        last, now = now, persist(_stars(now), "stars")
        drop_scratch(spark, last)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Parts into which the rows of one root are dealt for a join.
SPREAD = 32


def join_spread(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key: a key of a third of all rows is dealt to many tasks."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
    every = few.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return dealt.join(every, [key, "__part"]).drop("__part")


#: A key is hot if it holds more than one row in so many; fewer keys than that can be hot.
HOT = 1000


def join_hot(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``few``, which has at most one row a key, where any key may hold a third of all rows.

    Keys are counted before they are shuffled. Those with more than a ``HOT``-th of the rows, which are fewer than
    ``HOT`` and are broadcast, are dealt to ``SPREAD`` tasks each; all others meet by their key alone, so that
    ``few`` is repeated for hot keys only. ``rows`` is read twice, the first time for the key, unless ``counts`` (key and
    number of rows) tells of every key that has more than one row. A null key meets nothing.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*"))
        total = counts.toDF(key, "__n").agg(F.sum("__n").alias("__all"))
    else:
        total = rows.agg(F.count("*").alias("__all"))
    counts = counts.toDF(key, "__n")
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * HOT > F.col("__all")).select(key, F.lit(SPREAD).alias("__parts"))
    hot = F.broadcast(hot)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    # Rows without a key would all meet in one task of an outer join.
    parts = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.coalesce("__parts", F.lit(1)))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*plain), parts)).drop("__parts")
    last = F.coalesce("__parts", F.lit(1)).cast("long") - 1
    every = few.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__parts")
    return dealt.join(every, [key, "__part"], how).drop("__part")


def classed(rows: DataFrame, to: str) -> DataFrame:
    """``rows`` (least, root and others) with the least ``least`` of their root; a row without a root is a class of its own."""
    linked = rows.where("root IS NOT NULL")
    few = linked.groupBy("root").agg(F.min("least").alias(to))
    return rows.where("root IS NULL").withColumn(to, F.col("least")).unionByName(join_spread(linked, few, "root"))
