"""What depends on the row before, over streams of any length: no stream is one task's work.

Rows are sorted by ranges of (stream, order) over all partitions and numbered from nought; so many numbers are a bucket, and
tasks work on buckets. What a bucket must know of the rows before it is carried in:

- the text just before it: a bucket's last row is shown to the next bucket as well;
- the last kept context, and the number of islands so far: one row a bucket, summed up over the buckets before;
- the open block (see ``blocks``): a function from what is open before a bucket to what is open after it, composed over
  groups of buckets and groups of groups.

Only identities, hashes and lengths travel here, 128 bits for what is compared; texts stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a bucket.
ROWS = 1 << 16
ROW = ("__h", "__g")


def _hashes(columns: list[str]) -> tuple[Column, Column]:
    """128 bits of some columns, in which a null is told apart from what stands beside it."""
    each = [c for name in columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return F.xxhash64(*each), F.xxhash64(F.lit(7), *each)


def identified(rows: DataFrame) -> DataFrame:
    """Adds a hash of the whole row, by which what is found of it returns to it. Rows alike in all columns are one row."""
    h, g = _hashes(rows.columns)
    return rows.withColumns(dict(zip(ROW, (h, g), strict=True)))


def numbered(rows: DataFrame, stream: str, order: str, text: str, context: tuple[str, ...], size: int = ROWS, length: str | None = None, at: str | None = None) -> DataFrame:
    """(stream, row, text and context hashes, length, pos, bucket) of distinct ``identified`` rows, in order; written.

    ``text`` may be a key of the text, if ``length`` names its length. ``at`` orders rows of one order and length; without it their hashes do.
    """
    pair = lambda name, of: {f"__{name}{k}": c for k, c in enumerate(_hashes(of))}
    known = [c for c in context if c in rows.columns]
    ties = {"__at": F.col(at)} if at else {}
    narrow = rows.select(F.col(stream).alias("__s"), F.col(order).alias("__o"), *ROW, F.coalesce(F.char_length(text) if length is None else F.col(length), F.lit(0)).alias("__len"), *(c.alias(n) for n, c in (pair("t", [text]) | pair("c", known or [text]) | ties).items()))
    return dealt(narrow.dropDuplicates([*ROW]), ["__s", "__o", "__len", *ties, *ROW], size).drop("__o", *ties)


def dealt(rows: DataFrame, by: list[str], size: int = ROWS) -> DataFrame:
    """``rows`` sorted by ranges over all partitions and written, with ``pos``, their number in order, and ``bucket``."""
    at = F.monotonically_increasing_id()
    in_order = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(in_order.withColumns({"__part": F.shiftright(at, 33), "__place": at.bitwiseAND((1 << 33) - 1)}), "placed")
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(F.count("*")).collect()):  # one number a partition
        starts.append((part, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __start long"))
    pos = F.col("__start") + F.col("__place")
    return placed.join(offsets, "__part").withColumns({"pos": pos, "bucket": F.call_function("div", pos, F.lit(size))}).drop("__part", "__place", "__start")


def _same(a: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(a[n]) for n in names])


def repeats(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """``numbered`` rows without those whose text is that of the row before."""
    ends = F.pmod(F.col("pos"), F.lit(size)) == size - 1
    shown = rows.withColumn("__in", F.explode(F.when(ends, F.array("bucket", F.col("bucket") + 1)).otherwise(F.array("bucket"))))
    before = F.lag(F.struct("__s", "__t0", "__t1")).over(Window.partitionBy("__in").orderBy("pos"))
    marked = shown.withColumn("__before", before).where("__in = bucket")
    return marked.where(F.col("__before").isNull() | ~_same(F.col("__before"), ("__s", "__t0", "__t1"))).drop("__in", "__before")


def changes(rows: DataFrame) -> DataFrame:
    """Adds ``changed``: whether the stream or the context differs from that of the row before among ``rows``."""
    rows = written(rows, "kept")
    here = ("__s", "__c0", "__c1")
    last = rows.groupBy("bucket").agg(F.max_by(F.struct(*here), "pos").alias("__carried"))
    carried = last.withColumn("__carried", F.lag("__carried").over(Window.orderBy("bucket")))
    inside = F.lag(F.struct(*here)).over(Window.partitionBy("bucket").orderBy("pos"))
    met = rows.join(carried, "bucket").withColumn("__before", F.coalesce(inside, F.col("__carried")))
    return met.withColumn("changed", F.col("__before").isNull() | ~_same(F.col("__before"), here)).drop("__before", "__carried")


def counted(rows: DataFrame) -> DataFrame:
    """Adds ``island``: how many rows of the stream have ``changed`` so far."""
    rows = written(rows, "changes")
    one = F.col("changed").cast("int")
    sums = rows.groupBy("__s", "bucket").agg(F.sum(one).alias("__n"))
    earlier = sums.withColumn("__earlier", F.sum("__n").over(Window.partitionBy("__s").orderBy("bucket")) - F.col("__n")).select(F.col("__s").alias("__s2"), F.col("bucket").alias("__b2"), "__earlier")
    inside = F.sum(one).over(Window.partitionBy("__s", "bucket").orderBy("pos"))
    met = rows.join(earlier, (F.col("bucket") == F.col("__b2")) & F.col("__s").eqNullSafe(F.col("__s2")))
    return met.withColumn("island", F.col("__earlier") + inside).drop("__s2", "__b2", "__earlier")
