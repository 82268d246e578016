"""Personal data: fixed patterns, and what bootstrapped contexts add to them.

Emails, addresses, cards and phones are found by fixed patterns. They and a few certain kinds of secrets
are seed entities. Around an entity stand its lexical patterns: the two words before it, the words on
either side, and the key of an assignment. Patterns and the identifier-shaped strings that stand in
them form a bipartite graph. Rounds of joins score patterns by the share of their strings that are
known, and strings by the patterns they stand in; confident patterns then discover strings that no
fixed pattern knows. An identifier-shaped string holds a digit and six characters or more between
delimiters and base spans, however long it is.

Edge cases: a null text counts as an empty one and has no spans; rows are told apart by id and text, so
that rows of one id, or without one, have their own spans, and rows that repeat have the same; without
seeds no pattern is induced; an empty table gives an empty result; further columns are ignored by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist

KINDS = ("email", "ip", "card", "phone", "secret")
#: Rounds at most; fewer where a round changes nothing.
ROUNDS = 10
#: A pattern is trusted if so many distinct strings in it are known, and that share of all of them and one
#: more (so that four known ones of four are the least); a string is accepted from that score on.
SUPPORT, CONFIDENCE, ACCEPTED = 4, 0.8, 0.9
#: Longer words stand in a pattern as their hash.
WORD_CHARS = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails at its start fails everywhere, so a search begins at runs only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPACES = " \t\n\v\f\r"
_DELIMITERS = frozenset(_SPACES + "\"'()[]{}<>=,;&?!#*$%|")
_END = re.compile(r"[\x20\x09-\x0D\"'()\[\]{}<>=,;&?!#*$%|]")
_ASSIGNED = re.compile(r"[ \"']{0,3}[=:][ \"']{0,3}\Z")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NOISE = re.compile(r"[0-9\"'()\[\]{}<>#*$%&!?,;.:=|]")
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{12,}")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _plain(word: str) -> str:
    """A word of a pattern: lower-cased, without digits and punctuation."""
    return _short(_NOISE.sub("", word).lower())


def _left(text: str, end: int) -> tuple[str, int]:
    """The word that ends before ``end``, and where it begins."""
    while end and text[end - 1] in _SPACES:
        end -= 1
    start = end
    while start and text[start - 1] not in _SPACES:
        start -= 1
    return text[start:end], start


def _short(word: str) -> str:
    return word if len(word) <= WORD_CHARS else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def _key(text: str, start: int) -> str:
    """The whole name, from its first letter, to which the string at ``start`` is assigned; empty if there is none of two characters."""
    sign = _ASSIGNED.search(text, max(0, start - 7), start)
    if not sign:
        return ""
    begin = sign.start()
    while begin and text[begin - 1] in _KEY_CHARS:
        begin -= 1
    name = text[begin : sign.start()].lower().lstrip("0123456789_.-")
    return _short(name) if len(name) >= 2 else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a string: its key, the two words before it, and the words on either side."""
    near, at = _left(text, start)
    far, _ = _left(text, at)
    while end < len(text) and text[end] in _DELIMITERS:
        end += 1
    stop = _SPACE.search(text, end)
    near, far, right = _plain(near), _plain(far), _plain(text[end : stop.start() if stop else len(text)])
    key = _key(text, start)
    found = [f"key {key}"] if key else []
    if near and far:
        found.append(f"before {far} {near}")
    if near and right:
        found.append(f"around {near} {right}")
    return found


def strings(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-shaped strings outside the base spans."""
    low, gaps = 0, []
    for a, b in sorted((a, b) for _, a, b in base):
        gaps.append((low, a))
        low = max(low, b)
    for low, high in [*gaps, (low, len(text))]:
        while low < high and (m := _DIGIT.search(text, low, high)):
            start, stop = m.start(), _END.search(text, m.start(), high)
            while start > low and text[start - 1] not in _DELIMITERS:
                start -= 1
            low = end = stop.start() if stop else high
            while start < end and text[start] in ".:-/":
                start += 1
            while start < end and text[end - 1] in ".:-/":
                end -= 1
            if end - start >= 6 and _DIGIT.search(text, start, end):
                yield start, end


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str], str, str | None]]:
    """(start, end, patterns, string, seed kind) of the base entities, then of the other strings."""
    found = [(a, b, patterns(text, a, b), text[a:b].lower(), kind) for kind, a, b in base]
    return found + [(a, b, patterns(text, a, b), text[a:b].lower(), "secret" if _SECRET.fullmatch(text, a, b) else None) for a, b in strings(text, base)]


SCANNED = (
    "doc_id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "found array<struct<start:int,end:int,patterns:array<string>,value:string,kind:string,base:boolean>>"
)
NO_ID = -(1 << 63)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: the hash of its text, counts, the base spans as text, and every occurrence."""
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("value", pa.string()), ("kind", pa.string()), ("base", pa.bool_())])
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(item)]
    names = ["doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for text in part.column(2):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                    found = [dict(zip(("start", "end", "patterns", "value", "kind", "base"), (*f, i < len(base)), strict=True)) for i, f in enumerate(occurrences(text, base))]
                    rows.append((*n, ",".join(f"{k}:{a}:{b}" for k, a, b in base), found))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SCANNED)


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, confidence) and accepted strings (value, kind).

    ``found`` has pattern, value and kind (null if the string is no seed). Each round is a join of the
    distinct edges with the known strings and two aggregates; sums are made before the shuffle, so a
    frequent pattern is not one task's work.
    """
    edges = persist(found.where("pattern IS NOT NULL").select("pattern", "value").distinct(), "edges")
    seeds = persist(found.where("kind IS NOT NULL").select("value", "kind").distinct(), "seeds")
    size = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    known, before = seeds, None
    trusted = size.where("false").select("pattern", F.lit("").alias("kind"), F.lit(0.0).alias("confidence"))
    for _ in range(rounds):
        hits = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        scored = hits.where(F.col("hits") >= SUPPORT).join(size, "pattern").withColumn("confidence", F.col("hits") / (F.col("all") + 1))
        trusted = persist(scored.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"), "patterns")
        # A string is as sure as it is unlikely that all its patterns err.
        doubt = F.sum(F.log1p(-F.col("confidence")))
        learned = edges.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= ACCEPTED)
        known = persist(seeds.unionByName(learned.select("value", "kind")).distinct(), "known")
        now = known.agg(F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return trusted, known


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, mark, n_email, n_ip, n_card, n_phone, base, spans): both lists as kind:start:end; ``mark`` is the text's hash."""
    scanned = persist(scan(docs), "scanned").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = scanned.select("id", "mark", F.inline("found"))
    trusted, known = bootstrap(found.select(F.explode_outer("patterns").alias("pattern"), "value", "kind"), rounds)
    new = found.where("NOT base").drop("kind", "base")
    by_pattern = new.withColumn("pattern", F.explode("patterns")).join(trusted.select("pattern", "kind"), "pattern")
    added = by_pattern.drop("pattern").unionByName(new.join(known, "value"))
    spans = added.groupBy("id", "mark").agg(F.collect_set(F.struct("start", _place(F.col("kind")).alias("k"), "end")).alias("added"))  # no more than the document has tokens
    base = F.transform(F.filter("found", lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), _place(x["kind"]).alias("k"), x["end"].alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,k:bigint,end:int>>"))))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"].cast("int")), x["start"], x["end"])), ",")
    return scanned.join(spans, ["id", "mark"], "left").select("doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", text.alias("spans"))


def mask(text: str, spans: str) -> str:
    """Spans become their kind in brackets; touching and nested ones are masked together."""
    out, last = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        a, b = int(start), int(end)
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span masked in ``text``; other columns as they are."""
    spans = find(docs, rounds).where("spans <> ''").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("mark").alias("__mark"), F.col("spans").alias("__spans")).distinct()
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__mark": F.xxhash64("text")})
    joined = keyed.join(spans, ["__id", "__mark"], "left").select(*docs.columns, "__spans")
    at = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text"), batch.column("__spans")
            masked = pa.array([t.as_py() if not s.is_valid or not t.is_valid else mask(t.as_py(), s.as_py()) for t, s in zip(texts, marks, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([masked if c == "text" else batch.column(c) for c in at], names=at)

    return joined.mapInArrow(run, joined.drop("__spans").schema)
