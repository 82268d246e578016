"""Sets of keys that only grow, batch by batch, and filters that say which batches can hold a key.

A batch's keys lie in buckets by their hash, sorted. Beside them is a Bloom filter in rows: blocks of 4096 bits, as many as
give ten bits a key; a key sets five bits of one block. New keys meet the filters by block, so that only batches and buckets
which may hold one of them are read at all: what is new costs what filters cost, 1.3 bytes a known key, and no text is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16
BLOCK_BITS, WORD_BITS, BITS_A_KEY = 4096, 64, 10
PROBES = 5
FILTER = "blocks long, block long, words array<long>"


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(BUCKETS)).cast("int")


def _block(key: str, blocks: Column) -> Column:
    return F.xxhash64(F.col(key)).bitwiseAND(blocks - 1)


def _bits(key: str) -> list[Column]:
    """Five times twelve bits of a hash of its own."""
    h = F.xxhash64(F.lit(1), F.col(key))
    return [F.shiftrightunsigned(h, 12 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)]


def bloom(keys: DataFrame, n: int) -> DataFrame:
    """The filter of ``keys`` (one column, ``n`` of them): blocks in which no bit is set have no row."""
    key = keys.columns[0]
    blocks = 1
    while blocks * BLOCK_BITS < n * BITS_A_KEY:
        blocks *= 2
    each = keys.where(F.col(key).isNotNull()).select(_block(key, F.lit(blocks).cast("long")).alias("block"), F.explode(F.array(*_bits(key))).alias("__bit"))
    words = each.select("block", F.call_function("div", "__bit", F.lit(WORD_BITS)).cast("int").alias("__w"), F.expr(f"shiftleft(1L, CAST(__bit % {WORD_BITS} AS INT))").alias("__v"))
    merged = words.groupBy("block", "__w").agg(F.bit_or("__v").alias("__v"))
    rows = merged.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("__w", "__v"))).alias("__m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // WORD_BITS - 1)), lambda w: F.coalesce(F.element_at("__m", w), F.lit(0).cast("long")))
    return rows.select(F.lit(blocks).cast("long").alias("blocks"), "block", filled.alias("words"))


def may_hold(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(key, batch) of every batch whose filter has the key's bits; ``filters`` has a batch in each row."""
    key = keys.columns[0]
    sizes = [r[0] for r in filters.select("blocks").distinct().collect()]  # powers of two: 40 at most
    asked = keys.where(F.col(key).isNotNull()).distinct().select(key, F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)).cast("array<long>")).alias("blocks"))
    met = asked.withColumn("block", _block(key, F.col("blocks"))).join(filters, ["blocks", "block"])
    is_set = lambda bit: (F.get("words", F.call_function("div", bit, F.lit(WORD_BITS)).cast("int")).bitwiseAND(_one_at(bit)) != 0)
    return met.where(reduce(lambda a, b: a & b, [is_set(b) for b in _bits(key)])).select(key, "batch")


def _one_at(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD_BITS)).cast("int"))
