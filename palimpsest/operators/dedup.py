"""Dedup by content hash, by neighbouring text, and against what is already indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROW, ROWS, identified, numbered, repeats
from .scratch import written


def first_occurrence(rows: DataFrame, key: str = "content_hash", order: str | tuple[str, ...] = "id") -> DataFrame:
    """The first row of each key; rows without a key all stay.

    Ranks are limited before the shuffle (one row a key and partition), so a hot key is cheap.
    """
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("__n", ranked).where("__n = 1").drop("__n")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def drop_consecutive(rows: DataFrame, text: str = "text", stream: str = "stream_key", order: str = "id", size: int = ROWS, length: str | None = None, at: str | None = None) -> DataFrame:
    """Without rows whose text equals the previous row's, whatever else changes between them.

    A stream may be of any length: see ``ordered``. Rows alike in every column are one row; of one order the shorter text is first.
    ``text`` may be a key of the text (see ``texts``), if ``length`` names its length; then no text is written or shuffled.
    ``at`` orders texts of one order and length.
    """
    whole = written(identified(rows), "rows")
    kept = repeats(numbered(whole, stream, order, text, (), size, length, at), size).select(*ROW)
    return whole.dropDuplicates([*ROW]).join(kept, [*ROW], "left_semi").drop(*ROW)


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``seen`` (one column of that name); rows without a key stay."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")
