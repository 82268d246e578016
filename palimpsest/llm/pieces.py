"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words that no piece of the model crosses. The distinct words of a batch lie in flat
arrays of symbols; each round looks up the rank of every neighbouring pair, takes the least rank of
each word, merges its leftmost occurrences at once and compacts the arrays, until no pair of the
model remains.

A merge can make a pair of lower rank than its own. Where the model allows that, the round merges
the leftmost occurrence only, which keeps the order of the sequential algorithm. So that a text without
spaces does not take a round a merge, long words are first cut between characters that no piece has
side by side, and what is still long is merged by a queue of pairs.

Edge cases: a null text counts as an empty one, which has no ids and decodes to an empty text;
characters outside the model become their bytes; repeated rows are encoded alike; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Distinct words that a worker remembers; longer words are not remembered.
CACHED, LONGEST = 800_000, 64
#: Longer words, where no cut makes them shorter, are merged by a queue.
QUEUED = 256
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """The model's tables: pieces, ranks of pairs and bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) for k in range(n)]
        normal = [k for k in range(n) if not special[k]]
        self.ids = {self.pieces[k]: k for k in normal}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.byte_of = {int(k): b for b, k in enumerate(self.byte_ids)}
        self.control = {k for k in range(n) if sp.is_control(k)}
        self.unknown = sp.unk_id()
        self.surface = [
            b"" if k in self.control else bytes([self.byte_of[k]]) if k in self.byte_of else " ⁇ ".encode() if k == self.unknown else p.replace(SPACE, " ").encode()
            for k, p in enumerate(self.pieces)
        ]
        self.decimal = [str(k) for k in range(n)]
        score = np.array([sp.get_score(k) for k in range(n)])
        # Higher scores merge first; equal scores are one rank, so that the leftmost wins.
        ranks = np.unique(-score, return_inverse=True)[1]
        chars = {c for p in self.ids for c in p}
        # Single characters that are no pieces get numbers above the pieces; others cannot merge.
        self.symbol = dict(self.ids)
        for c in sorted(chars - self.ids.keys()):
            self.symbol[c] = len(self.pieces) + len(self.symbol)
        pairs = sorted(
            (self.symbol[p[:k]] << 32 | self.symbol[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol
        )
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.merged = np.array([i for _, i in pairs] or [0], np.int64)
        self.ranks = ranks[self.merged]
        lowest: dict[int, int] = {}
        for key, rank in zip(self.keys.tolist(), self.ranks.tolist(), strict=True):
            for part in (key >> 32, key & 0xFFFFFFFF):
                lowest[part] = min(rank, lowest.get(part, rank))
        #: Pairs whose product can at once merge at the same or a lower rank.
        self.early = np.array([lowest.get(m, 1 << 40) <= r for m, r in zip(self.merged.tolist(), self.ranks.tolist(), strict=True)], bool)
        # Characters that are in no longer piece stand alone; words also end before a space that follows anything else.
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.crossed = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.newline_alone = "\n" not in inside
        self.foreign = len(self.pieces) + len(self.symbol) + 1
        self.table: dict[int, tuple[int, int]] | None = None

    def pair(self, key: int) -> tuple[int, int] | None:
        """(rank, merged) of one pair."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self.table.get(key)

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece could span."""
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.beside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def queued(model: PieceModel, word: str) -> list[int]:
    """Ids of one long word: pairs wait in a queue by rank, then place, and a merge adds its two new pairs."""
    symbols = np.array([model.symbol.get(c, model.foreign) for c in word], np.int64)
    place = model.lookup(symbols[:-1], symbols[1:])
    at = np.flatnonzero(place >= 0)
    waiting = list(zip(model.ranks[place[at]].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), model.merged[place[at]].tolist(), strict=True))
    heapify(waiting)
    own = symbols.tolist()
    after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))

    def add(k: int, j: int) -> None:
        if (pair := model.pair(own[k] << 32 | own[j])) is not None:
            heappush(waiting, (pair[0], k, own[k], own[j], pair[1]))

    while waiting:
        _, k, a, b, new = heappop(waiting)
        j = after[k]
        # A symbol only ever grows, so equal symbols are the pair that was put in.
        if own[k] != a or j >= len(own) or own[j] != b:
            continue
        own[k], own[j] = new, -1
        after[k] = after[j]
        if after[k] < len(own):
            before[after[k]] = k
            add(k, after[k])
        if before[k] >= 0:
            add(before[k], k)
    limit = len(model.pieces)
    ids: list[int] = []
    for k, s in enumerate(own):
        if s >= limit:
            ids += model.byte_ids[list(word[k].encode("utf-8", "surrogatepass"))].tolist()
        elif s >= 0:
            ids.append(s)
    return ids


def merge_words(model: PieceModel, words: list[str]) -> list[list[int]]:
    """Ids of each word."""
    if any(len(w) > QUEUED for w in words):
        short = iter(merge_words(model, [w for w in words if len(w) <= QUEUED]))
        return [queued(model, w) if len(w) > QUEUED else next(short) for w in words]
    if not words:
        return []
    flat = "".join(words)
    get, foreign = model.symbol.get, model.foreign
    symbols = np.array([get(c, foreign) for c in flat], np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    at = np.arange(len(symbols))  # where in ``flat`` the symbol starts
    done_symbols, done_word, done_at = [], [], []
    none = np.int64(1) << np.int64(40)
    while len(symbols) > 1:
        place = np.where(word[1:] == word[:-1], model.lookup(symbols[:-1], symbols[1:]), -1)
        rank = np.where(place >= 0, model.ranks[place], none)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(word)])
        least = np.minimum.reduceat(np.r_[rank, none], first)
        best = np.repeat(least, size)[:-1]
        hit = (rank == best) & (place >= 0)
        # Leftmost first: of touching hits every second one holds, and only one where a merge may overtake.
        where = np.flatnonzero(hit)
        if len(where):
            run = np.cumsum(np.r_[True, np.diff(where) > 1])
            start = np.searchsorted(run, run)
            keep = (np.arange(len(where)) - start) % 2 == 0
            careful = np.zeros(len(words), bool)
            careful[word[where[model.early[place[where]]]]] = True
            leftmost = np.r_[True, word[where[1:]] != word[where[:-1]]]
            where = where[keep & (leftmost | ~careful[word[where]])]
            symbols[where] = model.merged[place[where]]
            alive = np.ones(len(symbols), bool)
            alive[where + 1] = False
        else:
            alive = np.ones(len(symbols), bool)
        # Words without a pair leave the arrays.
        ended = np.repeat(least == none, size)
        done_symbols.append(symbols[ended])
        done_word.append(word[ended])
        done_at.append(at[ended])
        alive &= ~ended
        symbols, word, at = symbols[alive], word[alive], at[alive]
    symbols, word, at = (np.concatenate([*done, rest]) for done, rest in ((done_symbols, symbols), (done_word, word), (done_at, at)))
    order = np.argsort(at, kind="stable")
    symbols, word, at = symbols[order], word[order], at[order]
    limit = len(model.pieces)
    if (odd := np.flatnonzero(symbols >= limit)).size:
        # Characters that are no pieces become the pieces of their bytes.
        raw = {c: model.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist() for c in {flat[k] for k in at[odd].tolist()}}
        spelt = {k: raw[flat[a]] for k, a in zip(odd.tolist(), at[odd].tolist(), strict=True)}
        ids, owner = [], []
        for k, (i, w) in enumerate(zip(symbols.tolist(), word.tolist(), strict=True)):
            new = spelt.get(k) or [i]
            ids.extend(new)
            owner.extend([w] * len(new))
        word = np.array(owner)
    else:
        ids = symbols.tolist()
    ends = np.searchsorted(word, np.arange(len(words)), "right").tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Encodes and decodes whole texts, remembering words."""

    def __init__(self, path: str | None = None) -> None:
        self.model = PieceModel(path or model_path())
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        word = f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if self.model.newline_alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.cut = (lambda t: [t] if t else []) if self.model.crossed else re.compile(word).findall
        self.simple = self.model.newline_alone and not self.model.crossed

    def words(self, text: str) -> list[str]:
        """Words that no piece crosses. One that begins with neither mark nor line end follows a space.

        Spaces become the model's space mark, and one is put in front.
        """
        if not text:
            return []
        if not self.simple or SPACE in text or "\0" in text or "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return [w if w[0] == SPACE or w[0] == "\n" else f"\0{w}" for w in self.cut(SPACE + text.replace(" ", SPACE))]
        # Single spaces only: each word is remembered without its mark, and line starts with their line end.
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def spelling(word: str) -> str:
        if word[:1] == "\0":
            return word[1:]
        return word if word[:1] in (SPACE, "\n") else SPACE + word

    def learn(self, texts: list[list[str]]) -> None:
        """Makes all words known. What has not been met since the memory last filled up is forgotten."""
        if len(self.known) > CACHED // 2:
            self.known, self.older = {}, self.known
        missing = {w for words in texts for w in words if w not in self.known}
        again = missing & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        self.long = [w for w in new if len(w) > LONGEST]
        new = [w for w in new if len(w) <= LONGEST]
        self.known.update(zip(new, merge_words(self.model, list(map(self.spelling, new))), strict=True))
        for w in self.long:
            parts = self.model.parts(self.spelling(w))
            some = list(dict.fromkeys(parts))
            ids = dict(zip(some, merge_words(self.model, some), strict=True))
            self.known[w] = list(chain.from_iterable(map(ids.__getitem__, parts)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        self.learn(split)
        known = self.known.__getitem__
        ids = [list(chain.from_iterable(map(known, words))) for words in split]
        for w in self.long:
            del self.known[w]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8 (what is none becomes U+FFFD), the first space dropped."""
        m = self.model
        try:
            text = b"".join(map(m.surface.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        first = next((i for i in ids if i not in m.control), m.unknown)
        return text[1:] if first not in m.byte_of and m.pieces[first].startswith(SPACE) else text

    def _runs(self, ids: list[int]) -> Iterator[str]:
        raw = bytearray()
        for i in ids:
            if i in self.model.byte_of:
                raw.append(self.model.byte_of[i])
            else:
                yield _utf8(bytes(raw)) + self.model.surface[i].decode()
                raw.clear()
        yield _utf8(bytes(raw))


def _utf8(raw: bytes) -> str:
    """Each byte that begins no valid character becomes one replacement mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec_for(path: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(path)


def code(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of each text and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path or model_path())
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [[len(x) for x in ids], [digest(",".join(map(codec.model.decimal.__getitem__, x))) for x in ids], [digest(codec.decode(x)) for x in ids]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, CODED)
