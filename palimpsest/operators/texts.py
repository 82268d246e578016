"""Texts that many rows share: a row carries a text's key and length, and each text is trimmed, hashed and cut once.

A key is 128 bits of the text's hash, so that equal texts have one key. Texts travel only to where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_TEXT, strip


def key_of(text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))


def usable(text: str) -> tuple[Column, Column, Column]:
    """(text, key, length) of a stripped text; nulls if it is shorter than the minimum."""
    plain = strip(text)
    kept = F.when(F.char_length(plain) >= MIN_TEXT, plain)
    return kept.alias("text"), key_of(kept).alias("key"), F.char_length(kept).alias("length")


def stored(texts: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of each usable text, once."""
    found = texts.select(*usable(text)[:2]).where("key IS NOT NULL")
    return found.groupBy("key").agg(F.first("text").alias("text"))


def sequences(rows: DataFrame, keys: str = "keys") -> DataFrame:
    """Adds ``sequence``, 128 bits that name an array of keys."""
    return rows.withColumn("sequence", F.struct(F.xxhash64(keys).alias("a"), F.xxhash64(F.lit(7), keys).alias("b")))


def joined(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(sequence, text): the ``stored`` texts of each distinct sequence of ``rows``, joined by line ends.

    Sequences of one text, which are most where texts are long, need no shuffle of theirs.
    """
    distinct = rows.select("sequence", "keys").dropDuplicates(["sequence"])
    alone = distinct.where(F.size("keys") == 1).select("sequence", F.col("keys")[0].alias("key"))
    several = distinct.where(F.size("keys") > 1).select("sequence", F.posexplode("keys").alias("place", "key"))
    in_order = F.sort_array(F.collect_list(F.struct("place", "text")))
    together = several.join(texts, "key").groupBy("sequence").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))
    return alone.join(texts, "key").select("sequence", "text").unionByName(together)
