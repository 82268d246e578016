"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, personal data, packing.

Each stage takes all that its predecessor kept and returns the columns of ``documents``, others are
dropped; the last returns the pieces of the packed sequences. Null and repeated ids are rows like others:
rows are told apart by id and text, a null id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import lines, packing, pii, quality, resemblance
from palimpsest.llm.common import persist

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates are found by SimHash, then exactly (see ``resemblance``), and judged on sets of shingles of five words: a Jaccard similarity of 0.8 or more.
SHINGLE = 5


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.apply_rules(docs).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or resembles are gone; so are documents left without words."""
    found = lines.dedup(docs.select(*COLUMNS))
    return _shaped(found.where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: of least id, then of least text hash.

    A null id comes before all others. Of rows with one id and text one stays.
    """
    groups = resemblance.near_duplicates(docs, SHINGLE)
    first = groups.where("doc_id = component_id AND row = component_row").groupBy("doc_id", "row").agg(F.count("*").alias("__n"))
    first = persist(first.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__n"), "first")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__row": F.xxhash64("text")})
    kept = keyed.join(first, ["__id", "__row"])
    if first.where("__n > 1").isEmpty():
        return kept.select(*COLUMNS)
    once = kept.where("__n > 1").dropDuplicates(["__id", "__row"])
    return kept.where("__n = 1").unionByName(once).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is masked by its kind."""
    return _shaped(pii.redact(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Line dedup, bootstrapped patterns and packing have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persist(docs, name)
    return docs
