"""Text expressions: trimming, remapping, hashing, splitting, tokenising."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_LIMIT = 2200
MIN_TEXT = 12
SNIPPET = 280

# The code points that Unicode counts as white space.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"

# Characters as captured, and as typed on the other keyboard layout.
LAYOUT_FROM = "qazwQAZW;m,M<>"
LAYOUT_TO = "aqwzAQWZm,;?./"


#: The same, one by one.
_SPACES = "".join(chr(k) for k in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end; ``trim`` alone removes spaces only. No regular expression looks at what lies between."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(_SPACES))


def remap_layout(text: Column | str) -> Column:
    return F.translate(text, LAYOUT_FROM, LAYOUT_TO)


def chunk_hash(kind: Column | str, text: Column | str) -> Column:
    """24 hex digits of the SHA-256 of kind, NUL and text."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.substring(F.sha2(F.concat(F.coalesce(col(kind), F.lit("screen")), F.lit("\0"), F.coalesce(col(text), F.lit(""))), 256), 1, 24)


@F.pandas_udf(T.StringType())
def blake_chunk_hash(kind: pd.Series, text: pd.Series) -> pd.Series:
    """BLAKE2b of 96 bits, for indexes whose ids must stay compatible."""
    return pd.Series([hashlib.blake2b(f"{k or 'screen'}\0{t or ''}".encode(), digest_size=12).hexdigest() for k, t in zip(kind, text, strict=True)])


def pieces_of(text: str, limit: int = CHUNK_LIMIT) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at line ends where possible.

    A text within the limit is one piece. Otherwise whole lines are gathered while they fit; a line
    above the limit is cut at it, and its rest goes on as a line. Empty lines at the start of a
    piece are lost, so a text of line ends alone has no pieces.
    """
    if len(text) <= limit:
        return [text]
    done: list[str] = []
    held = ""
    for line in text.split("\n"):
        whole, rest = divmod(len(line), limit)
        if whole and not rest:  # a line of exactly n limits keeps its last part open
            whole, rest = whole - 1, limit
        if whole:
            done.extend([held] if held else [])
            done.extend(line[k * limit : (k + 1) * limit] for k in range(whole))
            held, line = "", line[whole * limit :]
        if not held:
            held = line
        elif len(held) + 1 + len(line) <= limit:
            held = f"{held}\n{line}"
        else:
            done.append(held)
            held = line
    return [*done, held] if held else done


def split_text(text: Column | str, limit: int = CHUNK_LIMIT) -> Column:
    """``pieces_of`` as a column. Lines are folded inside the JVM: no batch of long texts is held in Python."""
    col = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    state = lambda done, held: F.struct(done.alias("done"), held.alias("held"))
    one = lambda x: F.when(x == "", none).otherwise(F.array(x))

    def fold(a: Column, line: Column) -> Column:
        done, held, size = a["done"], a["held"], F.char_length(line)
        whole = F.floor((size - 1) / limit).cast("int")  # full pieces before the last part of a long line
        cut = F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.substring(line, k * limit + 1, F.lit(limit)))
        joined = F.char_length(held) + 1 + size <= limit
        return (
            F.when(size > limit, state(F.concat(done, one(held), cut), F.substring(line, whole * limit + 1, F.lit(limit))))
            .when(held == "", state(done, line))
            .when(joined, state(done, F.concat(held, F.lit("\n"), line)))
            .otherwise(state(F.concat(done, F.array(held)), line))
        )

    long = F.when(F.char_length(col) > limit, col)
    pieces = F.aggregate(F.split(long, "\n"), state(none, F.lit("")), fold, lambda a: F.concat(a["done"], one(a["held"])))
    return F.when(F.char_length(col) <= limit, F.array(col)).otherwise(pieces)


def _latin_bases() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode decompositions."""
    source, base = [], []
    for first, last in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for point in range(first, last + 1):
            parts = unicodedata.normalize("NFD", chr(point))
            if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
                source.append(chr(point))
                base.append(parts[0])
    return "".join(source), "".join(base)


LATIN_FROM, LATIN_TO = _latin_bases()
TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"


def tokens(text: Column | str) -> Column:
    """Lower-case tokens with Latin diacritics removed; other scripts keep theirs."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(col) == F.char_length(col)
    folded = F.regexp_replace(F.translate(col, LATIN_FROM, LATIN_TO), r"\p{Mn}", "")
    return F.filter(F.split(F.lower(F.when(ascii_only, col).otherwise(folded)), TOKEN_GAP), lambda t: t != "")


def query_phrases(query: str) -> list[list[str]]:
    """The phrases of a query: each word of it, tokenised; words without tokens match nothing."""
    table = str.maketrans(LATIN_FROM, LATIN_TO)
    phrases = []
    for word in query.split():
        plain = "".join(c for c in word.translate(table) if unicodedata.category(c) != "Mn").lower()
        kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain)  # as in ``TOKEN_GAP``
        found = "".join(kept).split(" ")
        found = [t for t in found if t]
        if found:
            phrases.append(found)
    return phrases


def snippet(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.char_length(col) > SNIPPET, F.concat(F.substring(col, 1, SNIPPET), F.lit("…"))).otherwise(col)
