"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import audit, edits, lines, manifest, packing, pieces, pii, quality, simhash, substrings, toxicity, urls, warc

LONG = " ".join(f"word{k % 997} the of" for k in range(60_000)) + "\n" + "x" * 50_000
EXTRA = ["key", "row", "fp", "kept", "n_words", "spans", "units", "host", "id", "n_lines", "part", "words"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "one", "a line of words\n\na line of words", LONG, "same text here again", "same text here again", "é中\x1c🙂  ", "mail bob@example.com now"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[6], (None, "no id at all", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in EXTRA}).coalesce(2)


RUNS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "packing": lambda d: packing.pack(d),
    "quality": lambda d: quality.apply_rules(d),
    "substrings": lambda d: substrings.dedup(d),
    "pieces": lambda d: pieces.code(d),
    "edits": lambda d: edits.against_next(d),
    "lines": lambda d: lines.dedup(d),
    "pii": lambda d: pii.find(d),
    "redact": lambda d: pii.redact(d),
    "urls": lambda d: urls.judge(d.withColumnRenamed("text", "url"), d.select(F.col("text").alias("url"), F.lit(1).alias("bad"))),
    "warc": lambda d: warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.encode("text", "UTF-8").alias("payload"), "key", "same_" if "same_" in d.columns else "row")),
}
RUNS |= {
    "classes": lambda d: edits.classified(d),
    "manifest": lambda d: manifest.manifest(d),
    "audit": lambda d: audit.audit(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), "key")),
    "toxicity": lambda d: toxicity.judge(d.withColumn("toxic", F.lit(0)), d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), "row")),
}
ONE_ROW_EACH = ["classes", "manifest", "toxicity", "simhash", "quality", "substrings", "pieces", "edits", "lines", "urls", "pii", "redact"]


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, docs, name):
    out = RUNS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert len(out) == docs.count()
    assert out


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, docs, name):
    assert RUNS[name](docs.where("false")).collect() == []


def test_other_columns_stay(docs):
    for out in (quality.apply_rules(docs), lines.dedup(docs), pii.redact(docs)):
        assert set(docs.columns) <= set(out.columns)
    assert lines.dedup(docs).select("row", "key").distinct().collect()[0][:] == (1, 1)
