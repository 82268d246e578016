"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, edits, lines, manifest, packing, pieces, pii, quality, simhash, substrings, toxicity, urls, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    return warc.round_trip(pages)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.code(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality rules' verdict on the text that it shows."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), urls.outcomes_of(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.classified(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || substr(sha1(html), {at} * 10 + 1, 10))::BIGINT >> {shift}) % 32 + 1]"
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       {" || ".join(_DIGIT.format(at=k // 8, shift=35 - 5 * (k % 8)) for k in range(32))} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D.,;:!?"''()]+'), lambda x: x <> '') AS bare
  FROM documents),
win AS (
  SELECT doc_id, i, w[i:i+4] AS x FROM d, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) t, unnest(range(0, 5)) AS s(k)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS shouts, len(l) AS n_lines,
         len(list_filter(bare, lambda x: list_contains([{stops}], x))) AS stops
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 12.0 * n_words
       AND n_symbols / n_words <= 0.10 AND shouts / n_words <= 0.25 AND stops / n_words >= 0.08
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.40) AS kept
FROM b
""".replace("{stops}", ", ".join(f"'{w}'" for w in sorted({w for s in quality.STOP_WORDS.values() for w in s.split()})))


def _weight_sql(level: str) -> str:
    """Moments of a beta-binomial over the groups of ``level``: what a prior is worth, and the overall rate."""
    return f"""
w_{level} AS (
  SELECT CASE WHEN k < 2 OR r <= 0 OR r >= 1 OR e <= 0 THEN 50.0::DOUBLE
              WHEN between_ > 0 THEN greatest(2.0::DOUBLE, least(50.0::DOUBLE, 1 / (between_ / (r * (1 - r) * e)) - 1)) ELSE 50.0::DOUBLE END AS weight,
         coalesce(r, 0)::DOUBLE AS rate
  FROM (SELECT *, (spread - bad * r) - (k - 1) * r * (1 - r) AS between_ FROM (
    SELECT count(*) AS k, sum(bad) AS bad, sum(bad)::DOUBLE / sum(n) AS r, sum(n) - sum(n * n)::DOUBLE / sum(n) AS e,
           sum(bad::DOUBLE * bad / n) AS spread FROM {level})))"""


def _shown_sql(html: str) -> str:
    for pattern in urls.HIDDEN:
        html = f"regexp_replace({html}, '{pattern}', ' ', 'g')"
    html = f"regexp_replace(regexp_replace({html}, '{urls.LINES}', chr(10), 'g'), '{urls.TAGS}', '', 'g')"
    for reference, character in urls.REFERENCES:
        html = f"replace({html}, '{reference}', {f"chr({ord(character)})"})"
    return html


OP7_SQL = (
    f"""
WITH judged AS ({OP4_SQL.replace("FROM documents", f"FROM (SELECT page_id AS doc_id, {_shown_sql('html')} AS text FROM pages WHERE html IS NOT NULL)")}),"""
    + r"""
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (
  SELECT *, list_filter(['example.net/en/', 'example.com/de/', 'org/fr/', 'net/'], lambda r:
      (host = split_part(r, '/', 1) OR ends_with(host, '.' || split_part(r, '/', 1))) AND starts_with(path, r[length(split_part(r, '/', 1)) + 1:]))[1] AS rule,
    regexp_replace(host, ':[0-9]*$', '') AS name
  FROM p),
l AS (SELECT *, CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*)$') THEN 100
    WHEN regexp_matches(name, '(^|\.)(ac|co|com|edu|gov|ne|net|or|org)\.[a-z][a-z]$') THEN 1 ELSE 0 END AS more, string_split(name, '.') AS part FROM q),
h AS (SELECT *, array_to_string(part[-2 - more:], '.') AS domain, array_to_string(part[-1 - more:], '.') AS suffix FROM l),
by_host AS (SELECT suffix, domain, host, count(*) AS n, sum((NOT kept)::INT) AS bad FROM h JOIN judged ON judged.doc_id = h.page_id GROUP BY ALL),
by_domain AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
"""
    + ",".join(_weight_sql(f"by_{x}") for x in ("suffix", "domain", "host"))
    + """,
s AS (SELECT x.suffix, (w.rate * w.weight + coalesce(c.bad, 0)) / (w.weight + coalesce(c.n, 0)) AS p
      FROM (SELECT DISTINCT suffix FROM h) x LEFT JOIN by_suffix c ON c.suffix = x.suffix, w_by_suffix w),
d AS (SELECT x.suffix, x.domain, (s.p * w.weight + coalesce(c.bad, 0)) / (w.weight + coalesce(c.n, 0)) AS p
      FROM (SELECT DISTINCT suffix, domain FROM h) x JOIN s ON s.suffix = x.suffix
      LEFT JOIN by_domain c ON c.suffix = x.suffix AND c.domain = x.domain, w_by_domain w),
b AS (SELECT host, p - 1.6449 * sqrt(p * (1 - p) / (m + 1)) AS bound FROM (
      SELECT x.host, w.weight + coalesce(c.n, 0) AS m, (d.p * w.weight + coalesce(c.bad, 0)) / (w.weight + coalesce(c.n, 0)) AS p
      FROM (SELECT DISTINCT suffix, domain, host FROM h) x JOIN d ON d.suffix = x.suffix AND d.domain = x.domain
      LEFT JOIN by_host c ON c.host = x.host, w_by_host w))
SELECT page_id, h.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN b.bound > least((SELECT rate FROM w_by_host), 0.5) THEN 'block' ELSE 'allow' END AS verdict
FROM h JOIN b ON b.host = h.host
"""
)


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_quality_rules": op4_quality_rules,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_url_filters": op7_url_filters,
        "op8_fingerprints": op8_fingerprints,
        "op9_line_dedup": op9_line_dedup,
        "op10_pii": op10_pii,
        "op11_manifest": op11_manifest,
        "op12_filter_audit": op12_filter_audit,
        "op13_toxicity": op13_toxicity,
    }


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM t, unnest(range(0, 35)) AS q(k) GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_filter(w, lambda x, j: g IS NULL OR NOT list_contains(g, j)) AS kept FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def _said(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Polynomial of the checksum, bit by bit: DuckDB has no function of it.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, xor({_CRC}, 4294967295) % 2 = 0 AS even FROM documents),
l AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")} AS now FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM l)),
p AS (SELECT doc_id, leaf, now, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
      FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source),
node AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM p
         UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, level, n, idx // 3),
sub AS (SELECT tree, h AS subroot FROM node WHERE n = 1),
top AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
        UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 3),
step AS (
  SELECT p.tree, p.idx, 0 AS part, x.level, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS b
  FROM p JOIN node x ON x.tree = p.tree AND x.n > 1 AND x.idx = p.idx // (3 ** x.level)::BIGINT JOIN node y ON y.tree = x.tree AND y.level = x.level AND y.idx // 3 = x.idx // 3 GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.idx, 1, x.level, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), ''), coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '')
  FROM p JOIN top x ON x.n > 1 AND x.idx = p.tree // (3 ** x.level)::BIGINT JOIN top y ON y.level = x.level AND y.idx // 3 = x.idx // 3 GROUP BY p.tree, p.idx, x.level),
way AS (SELECT tree, idx, list(a || '|' || b ORDER BY part, level) AS steps FROM step GROUP BY ALL),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(steps, []) AS w, now FROM p JOIN sub ON sub.tree = p.tree LEFT JOIN way ON way.tree = p.tree AND way.idx = p.idx),
g AS (SELECT *, list_reduce(list_prepend(now, w), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(w, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
        coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, o, step, o[step] AS f,
        sum(n) FILTER (NOT list_bool_or(list_select(fails, o[1:step]))) AS kept,
        sum(n) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(list_select(fails, o[1:step - 1])), false)) AS removed,
        sum(n) FILTER (fails[o[step]] AND coalesce(list_bool_or(list_select(fails, o[1:step - 1])), false)) AS redundant,
        sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
        sum(good) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(list_select(fails, o[1:step - 1])), false)) AS good_lost,
        sum(toxic) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(list_select(fails, o[1:step - 1])), false)) AS toxic_lost
      FROM c, o, unnest([1, 2, 3, 4, 5]) AS t(step) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_url_filters": OP7_SQL, "op11_manifest": OP11_SQL, "op12_filter_audit": OP12_SQL}
