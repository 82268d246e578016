"""The pipeline's rows against the stages in plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from palimpsest.llm import quality
from tests.conftest import DATA
from tests.llm.test_brute_force import WORD, slow_lines
from tests.llm.test_pii import found_in
from tests.llm.test_resemblance import kept_by_all_pairs


def good(text):
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    if n < 10 or 100 * len(repeated) > 20 * n:
        return False
    full = [x for x in text.split("\n") if WORD.search(x)]
    stops = {w for s in quality.STOP_WORDS.values() for w in s.split()}
    bare = [w for w in re.split(r"[\x20\x09-\x0D.,;:!?\"'()]+", text.lower()) if w]
    return (
        2 <= sum(map(len, words)) / n <= 12
        and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.10
        and text.count("!") / n <= 0.25
        and sum(w in stops for w in bare) / n >= 0.08
        and (len(full) - len(set(full))) / len(full) <= 0.40
    )


def masked(texts):
    """Texts with the spans that plain Python finds replaced by their kinds."""
    out = {}
    for i, (_, spans) in found_in(texts).items():
        text, last, parts = texts[i], 0, []
        for kind, a, b in spans:
            if a >= last:
                parts += [text[last:a], f"[{kind.upper()}]"]
            last = max(last, b)
        out[i] = "".join([*parts, text[last:]])
    return out


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if good(t)}
    lines = slow_lines(texts)
    texts = {i: t for i, t in lines.items() if WORD.search(t)}
    first = kept_by_all_pairs(texts)
    texts = masked({i: texts[i] for i in first})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r)
    for i, parts in held.items():
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


ROWS = [
    (1, "The quick brown fox of the north jumps over the lazy dog and then it is gone for good."),
    (1, "The quick brown fox of the north jumps over the lazy dog and then it is gone for good."),
    (1, "A second text with the same number is in here, and it is for the best to keep it as it is."),
    (None, "Write to amy@example.com or to the one that is at 10.0.0.1 if the number is not at hand."),
    (None, "This one is without a number too, and it was left in the table by the people of the house."),
    (None, None),
    (2, ""),
    (3, "Write to amy@example.com or to the one that is at 10.0.0.1 if the number is not at hand."),
]


def test_odd_rows_pass_each_stage_once(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    out = sorted((str(r.doc_id), r.text) for r in docs.collect())
    masked_ = "Write to [EMAIL] or to the one that is at [IP] if the number is not at hand."
    assert out == sorted([("1", ROWS[0][1]), ("1", ROWS[2][1]), ("None", masked_), ("None", ROWS[4][1])])
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), DATA).collect() == []


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert out == sorted([("1", ROWS[0][1]), ("1", ROWS[2][1]), ("None", ROWS[3][1]), ("None", ROWS[4][1]), ("None", "")])


def test_the_rules_are_computed_once(spark):
    kept = quality.apply_rules(spark.read.parquet(f"{DATA}/documents.parquet")).where("kept").select("doc_id", "text")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def wrapped(words, width):
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def test_near_duplicates_that_line_dedup_leaves(spark):
    """One text in lines of other lengths: no line is like another's, the documents are."""
    rng = np.random.default_rng(12)
    base = [[f"w{x}" for x in rng.integers(0, 10_000, 120)] for _ in range(5)]
    rows = [(10 * k + j, wrapped(words, width), "en", "s", 0) for k, words in enumerate(base) for j, width in enumerate((12, 30, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.count() == 15
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, lines, "").collect()) == [0, 10, 20, 30, 40]


def test_an_empty_table_and_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    docs.where("false").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    more = docs.selectExpr("*", *(f"1 AS {c}" for c in ("row", "key", "kept", "units", "start", "length", "sequence_id", "__id", "component_id")))
    more.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "c" / "documents.parquet"))
    clashing, plain = (corpus_pipeline.run(spark, str(tmp_path / d)) for d in "bc")
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert clashing.columns == plain.columns and sorted(clashing.select(pieces).collect()) == sorted(plain.select(pieces).collect()) != []
