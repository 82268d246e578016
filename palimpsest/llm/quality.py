"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the whole text; no user function runs.

Edge cases: a null text counts as an empty one; an empty text has no words and fails the base
rule; an empty table gives an empty result; rows with equal ids or texts are judged alike, each
by itself; other columns of the input are kept by ``apply_rules`` unless they carry the name of a
measure, in which case the measure replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let

#: Words in a repeated passage.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# The most frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "es": "de la que el en y los se las del un por con no una su para al es lo",
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
}


@dataclass(frozen=True)
class Rule:
    """A text is rejected if its measure lies outside ``low`` to ``high``, where given."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word, but for lines, which are per line that holds a word.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("shout_ratio", None, 0.25),
    Rule("stop_ratio", 0.08, None),
    Rule("dup_line_ratio", None, 0.40),
)


def _count_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("long")


def _words(text: Column, apart: str = SPACE_CLASS) -> Column:
    return F.filter(F.split(text, apart), lambda w: w != "")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _repeat_words(words: Column) -> Column:
    """Words covered by a window that is found twice or more in the text.

    Most texts repeat nothing: distinct hashes of the windows show that at once. The rest sort
    their windows by hash and compare the words of neighbours, so that n words cost n log n.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    window = lambda h, k: F.struct(h.alias("h"), k.alias("i"))

    def covered(x: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            a, b = F.get(x, k), F.get(x, other)
            equal = a["h"] == b["h"]
            for j in range(WINDOW):
                equal = equal & (F.get(words, a["i"] + j) == F.get(words, b["i"] + j))
            return F.coalesce(equal, F.lit(False))

        repeated = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        hits = F.array_sort(F.transform(repeated, lambda k: F.get(x, k)["i"]))
        gap = lambda p: F.transform(p, lambda v, k: F.least(F.get(p, k + 1) - v, F.lit(WINDOW)))
        return let(hits, lambda p: _total(gap(p)))

    def judged(h: Column) -> Column:
        unique = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(unique, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(h, window)), covered))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, judged))


def _counts(text: Column) -> Column:
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("all")))
    bare = _words(F.lower(text), r"[\x20\x09-\x0D.,;:!?\"'()]+")

    def struct(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _total(F.transform(words, F.char_length)).alias("word_chars"),
            _count_of(text, r"[#*$%&|<>]").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _count_of(text, "!").alias("n_shouts"),
            F.size(F.filter(bare, lambda w: w.isin(stops))).cast("long").alias("n_stops"),
        )

    return let(_words(text), struct)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules name."""
    clean = F.coalesce(F.col(text), F.lit(""))
    # Behind a generator of one row, which no filter passes: the counts are not computed anew for each rule.
    counted = docs.select("*", F.explode(F.array(_counts(clean))).alias("__q"))
    c = F.col("__q")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "n_words": c["n_words"],
            "word_chars": c["word_chars"],
            "n_symbols": c["n_symbols"],
            "n_dup_lines": c["lines"]["dup"],
            "n_repeat_words": c["n_repeat_words"],
            "mean_word_chars": per(c["word_chars"], c["n_words"]),
            "symbol_ratio": per(c["n_symbols"], c["n_words"]),
            "shout_ratio": per(c["n_shouts"], c["n_words"]),
            "stop_ratio": per(c["n_stops"], c["n_words"]),
            "dup_line_ratio": per(c["lines"]["dup"], c["lines"]["all"]),
        }
    ).drop("__q")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: true if every rule holds."""
    held = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            held = held & (F.col(rule.measure) >= F.lit(rule.low))
        if rule.high is not None:
            held = held & (F.col(rule.measure) <= F.lit(rule.high))
    return held


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept``; rejects nothing itself."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measures(docs, text).withColumn("base_failed", base)
    return judged.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
