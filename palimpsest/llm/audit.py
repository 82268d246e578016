"""How quality filters overlap: what each removes, repeats and loses in every order in which they may be applied.

Each document is one mask of the filters that it fails. Documents are counted by part and mask, so that what follows sees at
most 2^n numbers a part, however many documents there are. All orders are then visited by swaps of neighbours: of two orders
that differ by such a swap only the two swapped steps differ, and are added up anew from the mask's cells; a filter's
removals are added up along the walk, which over all orders is its Shapley value times the number of orders.

Edge cases: a null text counts as an empty one and a null part as an empty string; a row without an id is no copy of
another and nothing is a copy of it; rows that repeat an id and a text are not copies of each other; labels are the
greatest of an id's; an empty table has no parts and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let

#: A document is too short, repeats its words, or shouts; bit k of a mask is filter k.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_COUNTS = ("docs", "good", "toxic")


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A to D."""
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    by_words = let(words, lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    shouts = F.when(100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.char_length(text).cast("long"), 4).otherwise(0)
    return (by_words + shouts + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): documents by what they fail.

    Texts travel as their hashes. Rows are counted before each shuffle: repeated ids before they meet their labels, and the
    copies of a text by part, with the row of the least id, before the least of all parts is found. So neither an id
    nor a text of a third of all rows is one task's work. All copies count as failing, then the first is taken out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_mask(text).alias("mask"))
    rows = narrow.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("docs"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("__good"), is_one("toxic").alias("__toxic"))
    met = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["__good", "__toxic"])
    counts = F.struct("docs", (F.col("docs") * F.col("__good")).alias("good"), (F.col("docs") * F.col("__toxic")).alias("toxic"))
    counted = met.select("doc_id", "part", "key", "mask", counts.alias("__c")).select("*", "__c.*")
    copies = counted.groupBy("key", "part", "mask").agg(F.min(F.struct("doc_id", "__c")).alias("first"), *(F.sum(c).alias(c) for c in _COUNTS))
    texts = copies.groupBy("key").agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct("part", "mask", "first", *_COUNTS)).alias("rows"))
    each = texts.select("least", F.explode("rows").alias("r")).select("least", "r.*")
    kept = {c: F.when(F.col("first.doc_id") == F.col("least"), F.col("first.__c")[c]).otherwise(0) for c in _COUNTS}
    both = F.array(
        F.struct(F.col("mask"), *(kept[c].alias(c) for c in _COUNTS)),
        F.struct((F.col("mask") + COPY).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in _COUNTS)),
    )
    split = each.select("part", F.explode(both).alias("m")).select("part", "m.*").where("docs > 0")
    nobody = rows.where("doc_id IS NULL").select("part", "mask", "docs", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return split.unionByName(nobody).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def swaps(n: int) -> Iterator[int]:
    """Places whose content changes with the next one's, so that all orders of ``n`` things come up once each.

    The last thing sweeps through the others, to and fro; at each turn the others take one step of their own walk.
    """
    if n < 2:
        return
    others, down = swaps(n - 1), True
    while True:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + down
        down = not down


class Walk:
    """The steps of one order after another, over the counts of ``2**n`` masks."""

    def __init__(self, counts: dict[str, np.ndarray], n: int) -> None:
        self.counts, self.n = counts, n
        self.masks = np.arange(1 << n)
        docs = counts["docs"]
        self.fails = [int(docs[self.masks >> f & 1 == 1].sum()) for f in range(n)]
        self.only = [int(docs[1 << f]) for f in range(n)]
        self.shapley = [0] * n

    def step(self, before: int, f: int) -> dict:
        """What filter ``f`` does to documents that pass all of ``before``."""
        alive = self.masks & before == 0
        hit = alive & (self.masks >> f & 1 == 1)
        lost = {c: int(self.counts[c][hit].sum()) for c in _COUNTS}
        left = int(self.counts["docs"][alive].sum()) - lost["docs"]
        return {"kept": left, "removed": lost["docs"], "redundant": self.fails[f] - lost["docs"], "unique_fails": self.only[f], "good_lost": lost["good"], "toxic_lost": lost["toxic"]}

    def orders(self) -> Iterator[tuple[list[int], list[dict]]]:
        order = list(range(self.n))
        steps = [self.step((1 << k) - 1, k) for k in order]
        yield order, self._seen(order, steps)
        for at in swaps(self.n):
            order[at], order[at + 1] = order[at + 1], order[at]
            before = sum(1 << f for f in order[:at])
            steps[at], steps[at + 1] = self.step(before, order[at]), self.step(before | 1 << order[at], order[at + 1])
            yield order, self._seen(order, steps)

    def _seen(self, order: list[int], steps: list[dict]) -> list[dict]:
        for f, s in zip(order, steps, strict=True):
            self.shapley[f] += s["removed"]
        return steps


def walk_part(group: pd.DataFrame) -> pd.DataFrame:
    """All orders of one part, from its cells."""
    n = len(LETTERS)
    counts = {c: np.bincount(group["mask"], group[c], 1 << n).astype(np.int64) for c in _COUNTS}
    walk, rows = Walk(counts, n), []
    for order, steps in walk.orders():
        name = "".join(LETTERS[f] for f in order)
        rows.extend({"filter_order": name, "step": k, "__f": f} | s for k, (f, s) in enumerate(zip(order, steps, strict=True), 1))
    out = pd.DataFrame(rows)
    out["shapley"] = [walk.shapley[f] for f in out.pop("__f")]
    out.insert(0, "part", group["part"].iloc[0])
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row a part, order and step; see ``RESULT``."""
    return cells(docs, labels, part).groupBy("part").applyInPandas(walk_part, RESULT)
