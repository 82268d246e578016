"""Line dedup by an exact set-similarity join.

Lines are sets of words. Words are ordered by rarity (a fixed-size sketch of their frequencies, then
their hash); two lines with a Jaccard similarity of 0.8 or more share a word among the first few of
either, so lines meet at those words. Their first shared word may be a frequent one: then they share
two, and lines meet at pairs of frequent words, so that runs of such words stay short. Length, position
and a parity bitmap of the words rule out most that meet; the rest are verified on their whole word
sets. A line is removed if an earlier line (by document, then by place) has the same set or a similar
one, whether that line is removed or not.

Edge cases: a null text has no lines and stays null; lines without words are never removed; a null id
comes first; equal lines, also in one document or in repeated rows, keep the first only (rows with one
id are ordered line by line, then by the text's hash; of rows with one id and one text all but one lose
every line that holds words); an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, mix64, persist, release
from .parcels import PARCEL, binary, deal, delivered, each, opened, parcels_for
from .words import hashed, raw

SIMILAR = 0.8
#: Cells of the frequency sketch; a cell is one byte, an eighth of a binary logarithm a step.
CELLS = 1 << 22
PART = 1 << 16
#: Bits of a filter that selects lines for verification, or keys: sixteen a value, within these bounds. It lets a few others through.
FILTER = (1 << 20, 1 << 28)
#: Earliest candidates of a line that one run passes on; lines with more are looked at again if none of them holds.
WITNESSES = 12
#: Bytes of text that are read at once, but for longer lines; lines that a map task holds before it deals them out.
BYTES, LINES = 1 << 20, 100_000
#: Words that occur more often than this are frequent: a run of so many rows costs a task about a minute. Lines of up to
#: so many words meet at pairs of them.
FREQUENT, PAIRED = 200_000, 128
#: Runs of up to so many rows compare all their pairs at once.
SMALL_RUN = 96
#: Rows are sorted by sizes of up to so many words (12 bits beside the key); more count as so many there.
LONGEST = (1 << 12) - 1
#: Lines of more words have a bitmap of 128 bits, others of 64.
WIDE = 48
#: Sets of fewer words resemble none but equal ones.
LEAST = 4


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, number of its first line, whole lines), about ``BYTES`` at a time."""
    out, total = [], 0
    for row, text in enumerate(texts):
        at, number = 0, 0
        while True:
            end = len(text)
            if end - at > BYTES:
                cut = text.rfind(b"\n", at, at + BYTES)
                cut = cut if cut >= 0 else text.find(b"\n", at + BYTES)
                end = cut if cut >= 0 else end
            piece = text[at:end]
            out.append((row, number, piece))
            total += len(piece)
            if total >= BYTES:
                yield out
                out, total = [], 0
            if end == len(text):
                break
            at, number = end + 1, number + piece.count(b"\n") + 1
    if out:
        yield out


def _distinct(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of ``text`` that hold words: their numbers, where their words begin, and hashes of their distinct words."""
    words, starts = hashed(text)
    before = np.searchsorted(starts, np.flatnonzero(np.frombuffer(text, np.uint8) == 10))  # words before each line's end
    line = np.repeat(np.arange(len(before) + 1, dtype=np.uint64), np.diff(np.r_[0, before, len(starts)]))
    order = np.argsort(line << np.uint64(42) | words >> np.uint64(22))
    words, line = words[order], line[order]
    short = words >> np.uint64(22)
    if np.any((short[1:] == short[:-1]) & (line[1:] == line[:-1]) & (words[1:] != words[:-1])):
        order = np.lexsort((words, line))
        words, line = words[order], line[order]
    new = np.r_[True, (words[1:] != words[:-1]) | (line[1:] != line[:-1])][: len(words)]
    words, line = words[new], line[new]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    return line[first].astype(np.int64), first, words


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines that hold words, a bounded number at a time: the row and the number of each line, where its
    words begin, and the hashes of its distinct words."""
    for pieces in _pieces(texts):
        line, first, words = _distinct(b"\n".join(p for _, _, p in pieces))
        if not len(line):
            continue
        begins = np.cumsum([0, *(p.count(b"\n") + 1 for _, _, p in pieces)])
        piece = np.searchsorted(begins, line, "right") - 1
        yield np.array([r for r, _, _ in pieces])[piece], line - begins[piece] + np.array([k for _, k, _ in pieces])[piece], first, words


def _keys(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that name each line's set, whatever the order of its words; and the mixed words."""
    mixed = mix64(words)
    return np.add.reduceat(mixed, first), np.add.reduceat(mix64(mixed + np.uint64(0x9E3779B97F4A7C15)), first), mixed


def _cell(words: np.ndarray) -> np.ndarray:
    """The sketch's cell of 64-bit hashes, of which only the upper half is looked at."""
    return (words >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int64)


def _line_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    return (hashed(b"\n".join(p for _, _, p in pieces))[0] for pieces in _pieces(texts))


def frequencies(docs: DataFrame, text: str = "text", sets: Callable[[list[bytes]], Iterator[np.ndarray]] = _line_words) -> tuple[np.ndarray, int]:
    """The sketch of how often a word occurs (in lines, or in the sets that are made), as logarithmic bytes; its size is fixed.

    Partition sketches are merged by cell ranges, so that each reducer holds one range. The number is
    that of all occurrences.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                for words in sets(raw(batch.column(0).slice(k, 1024))):
                    np.add.at(cells, _cell(words), np.uint32(1))  # a number of another kind takes a slow way, ten times the time
        for k in range(0, CELLS, PART):
            used = np.flatnonzero(cells[k : k + PART])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([used.astype(np.uint16).tobytes()]), pa.array([cells[k : k + PART][used].tobytes()])], names=["part", "at", "n"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, np.uint64)
        for batch in tables:
            for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
                total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_steps(total).tobytes()]), pa.array([int(total.sum())])], names=["part", "steps", "n"])

    parts = docs.select(text).mapInArrow(count, "part int, at binary, n binary")
    merged = parts.groupBy("part").applyInArrow(merge, "part int, steps binary, n long").collect()
    sketch = np.zeros(CELLS, np.uint8)
    for r in merged:
        sketch[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["steps"], np.uint8)
    return sketch, sum(r["n"] for r in merged)


def _steps(total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, np.minimum(1 + 8 * np.log2(np.maximum(total, 1)), 255), 0).astype(np.uint8)


def _least_overlap(total: np.ndarray | int) -> np.ndarray:
    """Words that lines of so many words together must share: ceil(0.8 / 1.8 * total)."""
    return -(-4 * total // 9)


def _prefix(size: np.ndarray, shared: int = 1) -> np.ndarray:
    """Of similar sets, so many first words hold the first ``shared`` that they share."""
    return np.minimum(size - -(-4 * size // 5) + shared, size)


#: A line as packed: its set's key, its document, its row's mark, its number, size and bitmaps; then the first words by rarity.
PACKED = [np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint64]
#: What becomes of lines: the first of each set, with its id; the others, which go; and rows that repeat.
FIRST, GONE, COPY = 0, 1, 2
SETS = "kind int, id long, doc_id long, row long, number int, size int, bitmap long, second long, words binary"


def _found(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in SETS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    values = {"kind": pa.array(np.full(n, kind, np.int32))} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([values.get(k, pa.nulls(n, t)) for k, t in zip(names, kinds, strict=True)], names=names)


def _first_of_set(c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first line of each set, of the other lines, and of lines that repeat with their row."""
    order = np.lexsort((c[3], c[4], c[2], c[1], c[0]))
    key, key2, doc, row, number = (x[order] for x in c[:5])
    same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])
    new = np.r_[True, ~same][: len(order)]
    copy = np.r_[False, same & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (number[1:] == number[:-1])][: len(order)]
    return order[new], order[~new & ~copy], order[copy]


def line_sets(docs: DataFrame, sketch: np.ndarray, parcels: int, text: str = "text") -> DataFrame:
    """The first line of each set with the words of its prefix, later lines of the same set, and repeated rows.

    Map tasks keep the first of equal lines that they hold, so that a line of a third of all documents is
    a few rows of the shuffle.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(sketch)

    def shape(ids: np.ndarray, marks: np.ndarray, rarity: np.ndarray, chunk: tuple) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        rows, numbers, first, words = chunk
        size = np.diff(np.r_[first, len(words)])
        line = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        key, key2, mixed = _keys(words, first)
        bit = np.uint64(1) << (mixed & np.uint64(63))
        bitmap = np.bitwise_xor.reduceat(bit, first)
        second = np.where(size > WIDE, np.bitwise_xor.reduceat(np.where(mixed >> np.uint64(63), bit, np.uint64(0)), first), np.uint64(0))
        ordered = np.sort(line << np.uint64(40) | rarity[_cell(words)].astype(np.uint64) << np.uint64(32) | words >> np.uint64(32))
        taken = _prefix(size, 2)
        use = np.arange(len(words)) - np.repeat(first, size) < np.repeat(taken, size)
        columns = [key, key2, ids[rows], marks[rows], numbers.astype(np.int32), size.astype(np.int32), bitmap, second]
        return columns, ordered[use].astype(np.uint32), taken

    def deal_out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        c = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
        words, taken = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        first, later, _ = _first_of_set(c)
        begin = (np.cumsum(taken) - taken)[first]
        taken = taken[first]
        at = np.repeat(begin - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
        yield deal((c[0][first] % np.uint64(parcels)).astype(np.int32), [x[first] for x in c], words[at], taken)
        if len(later):
            gone = np.concatenate([np.array([len(later)], np.int64), c[2][later], c[3][later]]).tobytes() + c[4][later].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(c[0][later[0]] % np.uint64(parcels))], pa.int32()), pa.array([gone], pa.binary())], names=["parcel", "data"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, marks = part.column(0).to_numpy(), part.column(1).to_numpy()
                for chunk in _chunks(raw(part.column(2))):
                    held.append(shape(ids, marks, broadcast.value, chunk))
                    n += len(chunk[0])
                    if n > LINES:
                        yield from deal_out(held)
                        held, n = [], 0
        if held:
            yield from deal_out(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel, blobs in each(batches):
            if parcel < 0:
                for blob in blobs:
                    doc, row, number = opened([blob], [np.int64, np.int64, np.int32])
                    yield _found(GONE, len(doc), doc_id=doc, row=row, number=number)
                continue
            *c, words = opened(blobs, PACKED, np.uint32)
            first, later, copy = _first_of_set(c)
            yield _found(GONE, len(later), doc_id=c[2][later], row=c[3][later], number=c[4][later])
            if len(copy):
                rows = np.unique(np.stack([c[2][copy], c[3][copy]], axis=1), axis=0)
                yield _found(COPY, len(rows), doc_id=rows[:, 0], row=rows[:, 1])
            taken = _prefix(c[5].astype(np.int64), 2)
            begin = np.cumsum(taken) - taken
            for k in range(0, len(first), 20_000):
                pick = first[k : k + 20_000]
                size = taken[pick]
                at = np.repeat(begin[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                yield _found(FIRST, len(pick), id=np.arange(k, k + len(pick)) | parcel << 32, doc_id=c[2][pick], row=c[3][pick], number=c[4][pick], size=c[5][pick], bitmap=c[6][pick].view(np.int64), second=c[7][pick].view(np.int64), words=binary(words[at], size))

    return delivered(docs.select("doc_id", "row", text).mapInArrow(read, PARCEL)).mapInArrow(gather, SETS)


#: A prefix word (or pair of words) of a line: ``room`` is how many words it can share from there on.
ENTRY = "key long, room int, size int, bitmap long, second long, doc_id long, number int, id long"
ENTRIES = [np.uint64, np.int32, np.int32, np.uint64, np.uint64, np.int64, np.int32, np.int64]


def _entries(batch: pa.RecordBatch, rarity: np.ndarray, frequent: int) -> list[np.ndarray]:
    """The keys at which lines meet, with what the filters need, in the columns of ``ENTRY``."""
    words = np.frombuffer(b"".join(b.as_py() for b in batch.column("words")), np.uint32)
    size = batch.column("size").to_numpy().astype(np.int64)
    taken = _prefix(size, 2)
    owner, begin = np.repeat(np.arange(len(size)), taken), np.cumsum(taken) - taken
    place = np.arange(len(words)) - begin[owner]
    seen = rarity[words & np.uint32(CELLS - 1)]
    often = seen > _steps(np.array([frequent]))[0]
    # A word that the sketch saw once is in no other line.
    single = (place < _prefix(size)[owner]) & (seen > 1) & (~often | (size[owner] > PAIRED))
    keys, owners, rooms = [words[single].astype(np.uint64)], [owner[single]], [(size[owner] - place)[single]]
    paired = np.flatnonzero(often & (size[owner] <= PAIRED * 5 // 4))
    if len(paired):
        # Frequent words are the last of a prefix; lines with equally many of them are taken at once.
        line, first, n = np.unique(owner[paired], return_index=True, return_counts=True)
        for m in np.unique(n[n > 1]).tolist():
            of = n == m
            at = paired[first[of]][:, None]
            x, y = np.triu_indices(int(m), 1)
            a, b = words[at + x].astype(np.uint64), words[at + y].astype(np.uint64)
            keys.append((mix64((a << np.uint64(32) | b).ravel()) | np.uint64(1 << 63)))
            owners.append(np.repeat(line[of], len(x)))
            rooms.append(1 + (size[owner] - place)[(at + y).ravel()])
    owner = np.concatenate(owners)
    rest = [batch.column(k).to_numpy()[owner] for k in ("size", "bitmap", "second", "doc_id", "number", "id")]
    return [np.concatenate(keys), np.concatenate(rooms).astype(np.int32), rest[0], rest[1].view(np.uint64), rest[2].view(np.uint64), *rest[3:]]


def _expanded(lines: DataFrame, sketch: np.ndarray, frequent: int, wanted: np.ndarray | None = None) -> DataFrame:
    """One row a line and key; with a bitmap, of its keys and a few others only."""
    broadcast = lines.sparkSession.sparkContext.broadcast((sketch, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, asked = broadcast.value
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                c = _entries(batch.slice(k, 4096), rarity, frequent)
                if asked is not None:
                    use = _in_bitmap(asked, c[0].view(np.int64))
                    c = [x[use] for x in c]
                c = [x.view(np.int64) if x.dtype == np.uint64 else x for x in c]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, c)), names=[x.split()[0] for x in ENTRY.split(", ")])

    return lines.where(F.col("size") >= LEAST).mapInArrow(run, ENTRY)


def _apart(folded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two lines above ``WIDE`` words the bitmaps of 128 bits are compared, of which the first is folded into 64."""
    wide = np.where((a != 0) & (b != 0), a ^ b, np.uint64(0))
    return np.bitwise_count(folded ^ wide) + np.bitwise_count(wide)


class _Rows:
    """Rows sorted by key and size, and which pairs of them may be similar.

    52 mixed bits stand for a key: rows of two keys that share them meet too, and verification parts them.
    """

    def __init__(self, c: list[np.ndarray]) -> None:
        size_bits = np.uint64(LONGEST)
        by = mix64(c[0]) & ~size_bits | np.minimum(c[2].astype(np.uint64), size_bits)
        order = np.argsort(by)
        by = by[order]
        key = by >> np.uint64(12)
        same = key[1:] == key[:-1]
        some = np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, bool)  # a row alone meets none
        order, self.key, self.least = order[some], key[some], (by[some] & size_bits).astype(np.int64)
        self.bitmap, self.second, self.doc, self.number, self.id = (c[k][order] for k in (3, 4, 5, 6, 7))
        self.size = c[2][order]
        # Sets share at most the lesser ``room``, so that the other's size is limited by it.
        self.most = (9 * c[1][order].astype(np.int64) - 4 * self.size) // 4

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps differ: no more than the words that one of the lines has alone."""
        return _apart(self.bitmap[i] ^ self.bitmap[j], self.second[i], self.second[j])

    def may_match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similar sets differ in a ninth of their words together at most, and so do their bitmaps."""
        out = (self.size[i] <= self.most[j]) & (self.size[j] <= self.most[i])
        fit = np.flatnonzero(out)
        i, j = i[fit], j[fit]
        out[fit] = self.apart(i, j) * np.int32(9) <= self.size[i] + self.size[j]
        return out

    def ordered(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs with the earlier line first."""
        equal, level = self.doc[i] == self.doc[j], self.number[i] == self.number[j]
        early = (self.doc[i] < self.doc[j]) | equal & ((self.number[i] < self.number[j]) | level & (self.id[i] < self.id[j]))
        return np.stack([np.where(early, i, j), np.where(early, j, i)], axis=1)

    def small(self, first: np.ndarray, runs: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs (earlier, later) of small runs. A row is done with the first that is too large for it."""
        left = np.repeat(np.where(runs > SMALL_RUN, 0, runs), runs) - (np.arange(len(self.key)) - np.repeat(first, runs))
        at = np.arange(len(self.key))
        for step in range(1, SMALL_RUN):
            at = at[left[at] > step]
            at = at[self.least[at + step] <= self.most[at]]
            keep = at[self.may_match(at, at + step)]
            yield self.ordered(keep, keep + step)
            if not len(at):
                break

    def large(self, a: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs, later rows that have more) of one run: each row meets earlier rows of about its size."""
        by_size = a + np.argsort(self.size[a : a + n], kind="stable")
        place = np.empty(n, np.int64)
        place[np.lexsort((self.id[by_size], self.number[by_size], self.doc[by_size]))] = np.arange(n)
        size, most, bitmap, second = self.size[by_size], self.most[by_size], self.bitmap[by_size], self.second[by_size]
        low, high = np.searchsorted(size, -(-4 * size // 5)), np.searchsorted(size, np.minimum(most, 5 * size // 4), "right")
        for b in range(0, n, 512):
            hi = high[b : b + 512]
            got, live, found, more = np.zeros(len(hi), np.int64), np.arange(len(hi)), [], []
            for k in range(int(low[b : b + 512].min()), int(hi.max()), 1024):
                if not len(live):
                    break
                i, j = slice(k, k + 1024), b + live
                ok = place[i][None, :] < place[j][:, None]
                ok &= size[j][:, None] <= most[i][None, :]
                ok &= size[i][None, :] <= most[j][:, None]
                y, x = np.nonzero(ok)
                near = _apart(bitmap[k + x] ^ bitmap[j[y]], second[k + x], second[j[y]]) * np.int32(9) <= size[k + x] + size[j[y]]
                y, x = y[near], x[near]
                rank = got[live][y] + np.arange(len(y)) - np.searchsorted(y, y)
                few = rank < WITNESSES
                found.append(np.stack([by_size[k + x[few]], by_size[j[y[few]]]], axis=1))
                got[live] += np.bincount(y, minlength=len(live))
                full = got[live] > WITNESSES
                more.append(by_size[j[full]])
                live = live[~full & (hi[live] > k + 1024)]
            if found:
                yield np.concatenate(found), np.concatenate(more)


PAIRS = "id long, other long, more boolean"


def _unique(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return [a[new], b[new]]


def _candidates(entries: DataFrame) -> DataFrame:
    """(id, other, more): for each line and key earlier lines that may match it; ``more`` and no other line if there are others."""

    def out(rows: _Rows, pairs: np.ndarray) -> pa.RecordBatch:
        ids = _unique(rows.id[pairs[:, 1]], rows.id[pairs[:, 0]])
        return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.zeros(len(ids[0]), bool))], names=["id", "other", "more"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in each(batches):
            rows = _Rows(opened(blobs, ENTRIES))
            if not len(rows.key):
                continue
            first = np.flatnonzero(np.r_[True, rows.key[1:] != rows.key[:-1]])
            runs = np.diff(np.r_[first, len(rows.key)])
            pairs = np.concatenate(list(rows.small(first, runs)))
            pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
            few = np.arange(len(pairs)) - np.searchsorted(pairs[:, 1], pairs[:, 1]) < WITNESSES
            found = [(pairs[few], np.unique(pairs[~few, 1]))]
            large = zip(first[runs > SMALL_RUN].tolist(), runs[runs > SMALL_RUN].tolist(), strict=True)
            for some in chain([found], (rows.large(a, n) for a, n in large)):
                for pairs, more in some:
                    yield out(rows, pairs)
                    if len(more):
                        yield pa.RecordBatch.from_arrays([pa.array(rows.id[more]), pa.nulls(len(more), pa.int64()), pa.array(np.ones(len(more), bool))], names=["id", "other", "more"])

    return delivered(entries).mapInArrow(meet, PAIRS)


def _packed(lines: DataFrame, sketch: np.ndarray, frequent: int, parcels: int) -> DataFrame:
    """The entries of ``_expanded``, dealt to parcels by key."""
    broadcast = lines.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            return deal((mix64(c[0]) % np.uint64(parcels)).astype(np.int32), c)

        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                held.append(_entries(batch.slice(k, 20_000), broadcast.value, frequent))
                n += len(held[-1][0])
                if n > 8 * LINES:
                    yield dealt()
                    held, n = [], 0
        if held:
            yield dealt()

    return lines.where(F.col("size") >= LEAST).mapInArrow(run, PARCEL)


def _named(doc: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One number for a line's place."""
    at = mix64(row.view(np.uint64)) + number.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix64(mix64(doc.view(np.uint64)) ^ at).view(np.int64)


def _bitmap(values: DataFrame, of: Callable[..., np.ndarray] = lambda x: x) -> np.ndarray:
    """Numbers made from the rows as set bits, modulo a bounded size; merged by bit ranges."""
    schema = "part int, bits binary"
    size = min(max(FILTER[0], 1 << int(16 * values.count()).bit_length()), FILTER[1])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(of(*(c.to_numpy() for c in batch.columns)).astype(np.int64).view(np.uint64) % np.uint64(size)).astype(np.int64)
            for part in np.unique(at // (8 * PART)):
                bits = np.zeros(8 * PART, bool)
                bits[at[at // (8 * PART) == part] - part * 8 * PART] = True
                yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["part", "bits"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, np.uint8)
        for batch in tables:
            for bits in batch.column("bits"):
                total |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in values.mapInArrow(fill, schema).groupBy("part").applyInArrow(merge, schema).toLocalIterator():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["bits"], np.uint8)
    return out


def _in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values.astype(np.int64).view(np.uint64) % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _picked(bits: np.ndarray, ids: np.ndarray, marks: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(row, numbers) of the lines whose place is in the bitmap, for rows that have such lines; about ``LINES`` lines are looked at at once."""
    count = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // LINES)) + 1
    for rows in np.split(np.arange(len(texts)), cuts):
        n = count[rows]
        row, number = np.repeat(rows, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found = np.flatnonzero(_in_bitmap(bits, _named(ids[row], marks[row], number)))
        row, number = row[found], number[found]
        for at in np.split(np.arange(len(found)), np.flatnonzero(np.diff(row)) + 1) if len(found) else ():
            yield int(row[at[0]]), number[at].tolist()


PLACE = ["doc_id", "row", "number"]


def _word_sets(docs: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """(id, words) of the lines asked for (id and place).

    Their places go to the tasks as a bitmap, so that only those lines and a few others are hashed; the
    join that follows is exact.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(_bitmap(asked.select(*PLACE), _named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = broadcast.value
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, size = [], 0

            def sets() -> pa.RecordBatch:
                line, first, words = _distinct(b"\n".join(x for _, _, x in held))  # noqa: B023
                rows, numbers = np.array([r for r, _, _ in held], np.int64)[line], np.array([k for _, k, _ in held], np.int32)[line]  # noqa: B023
                ends = pa.array(np.r_[first, len(words)].astype(np.int32))
                return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(marks[rows]), pa.array(numbers), pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64)))], names=[*PLACE, "words"])  # noqa: B023

            texts = raw(batch.column(2))
            for r, picked in _picked(bits, ids, marks, texts):
                parts = texts[r].split(b"\n")
                held += [(r, k, parts[k]) for k in picked]
                size += sum(len(parts[k]) for k in picked)
                if size > BYTES:
                    yield sets()
                    held, size = [], 0
            if held:
                yield sets()

    found = docs.select("doc_id", "row", text).mapInArrow(run, "doc_id long, row long, number int, words array<long>")
    return found.join(asked, PLACE).select("id", "words")


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, text: str, repeated: bool) -> DataFrame:
    """The ids of the pairs (id, other) whose word sets have the similarity."""
    spark = docs.sparkSession
    ids = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    asked = persist(lines.select("id", *PLACE).join(ids, "id", "left_semi"), "asked")
    sets = _word_sets(docs, asked, text)
    sets = persist(sets.dropDuplicates(["id"]) if repeated else sets, "sets")  # rows that repeat have the same lines
    both = F.size(F.array_intersect("a", "b"))
    found = pairs.join(sets.toDF("id", "a"), "id").join(sets.toDF("other", "b"), "other")
    found = persist(found.where(9 * both >= 4 * (F.size("a") + F.size("b"))).select("id").distinct(), "similar")
    for done in (asked, sets):
        drop_scratch(spark, done)
    return found


def _with_rows(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``row``, which orders rows of one id: by the text's hash; equal rows share it."""
    return docs.withColumn("row", F.xxhash64(F.col(text)))


def removals(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Lines to remove as (doc_id, row, number), and rows that repeat as (doc_id, row); see ``_with_rows`` for ``row``."""
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = _with_rows(docs.select(order.alias("doc_id"), text), text)
    sketch, words = frequencies(base, text)
    sets = persist(line_sets(base, sketch, parcels_for(spark, words // 16), text), "sets")
    lines = sets.where(F.col("kind") == FIRST)
    release(spark)
    copies = persist(sets.where(F.col("kind") == COPY).select("doc_id", "row").distinct(), "copies")
    repeated = not copies.isEmpty()
    pairs = persist(_candidates(_packed(lines, sketch, frequent, parcels_for(spark, words // 8))), "pairs")
    release(spark)
    similar = _verified(base, lines, pairs.where("NOT more").select("id", "other").distinct(), text, repeated)
    left = persist(pairs.where("more").select("id").distinct().join(similar, "id", "left_anti"), "left")
    if not left.isEmpty():
        rest = persist(_all_candidates(lines, left, sketch, frequent), "rest")
        similar = similar.unionByName(_verified(base, lines, rest, text, repeated))
    alike = lines.select("id", *PLACE).join(similar, "id", "left_semi").select(*PLACE)
    gone = persist(sets.where(F.col("kind") == GONE).select(*PLACE).unionByName(alike), "gone")
    for done in (pairs, sets):
        drop_scratch(spark, done)
    release(spark)
    return gone, copies


def _all_candidates(lines: DataFrame, left: DataFrame, sketch: np.ndarray, frequent: int) -> DataFrame:
    """Every earlier line that may match one of ``left``: the exact way for lines with many candidates."""
    own = persist(_expanded(lines.join(left, "id", "left_semi"), sketch, frequent), "own")
    mine, theirs = own.alias("m"), _expanded(lines, sketch, frequent, _bitmap(own.select("key"))).alias("t")
    total = F.col("m.size") + F.col("t.size")
    need = F.ceil(4 * total / 9)
    before = F.struct("t.doc_id", "t.number", "t.id") < F.struct("m.doc_id", "m.number", "m.id")
    xor = lambda c: F.col(f"m.{c}").bitwiseXOR(F.col(f"t.{c}"))
    wide = F.when((F.col("m.second") != 0) & (F.col("t.second") != 0), xor("second")).otherwise(F.lit(0).cast("long"))
    apart = F.bit_count(xor("bitmap").bitwiseXOR(wide)) + F.bit_count(wide)
    near = (F.least("m.size", "t.size") >= need) & (F.least("m.room", "t.room") >= need) & (9 * apart <= total)
    met = mine.join(theirs, F.col("m.key") == F.col("t.key")).where(before & near)
    return met.select(F.col("m.id").alias("id"), F.col("t.id").alias("other")).distinct()


def _copies_told(marked: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds ``__copy``: true for all but one of the rows with one id and text.

    Such rows alone are written out first, with a number that then stays, so that exactly one of them is chosen
    whatever is recomputed.
    """
    if copies.isEmpty():
        return marked.withColumn("__copy", F.lit(False))
    same = (marked["__id"] == copies["doc_id"]) & (marked["__row"] == copies["row"])
    repeated = persist(marked.join(copies.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r")), (F.col("__id") == F.col("__d")) & (F.col("__row") == F.col("__r"))).drop("__d", "__r").withColumn("__n", F.monotonically_increasing_id()), "repeated")
    least = repeated.groupBy("__id", "__row").agg(F.min("__n").alias("__least"))
    told = repeated.join(least, ["__id", "__row"]).withColumn("__copy", F.col("__n") != F.col("__least"))
    return marked.join(copies, same, "left_anti").withColumn("__copy", F.lit(False)).unionByName(told.drop("__n", "__least").select(*marked.columns, "__copy"))


def dedup(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` without the removed lines, with ``n_lines`` and ``n_removed`` (of lines that hold words)."""
    found, copies = removals(docs, text, frequent)
    # No more numbers than the document has lines.
    gone = found.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("number").alias("__gone"))
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__row": F.xxhash64(F.col(text))})
    joined = _copies_told(marked, copies).join(gone, ["__id", "__row"], "left")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "n_lines long", "n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops = [], [], []
            numbers = batch.column("__gone").flatten().to_pylist()
            ends = np.cumsum(batch.column("__gone").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            for value, begin, end, copy in zip(batch.column(text).cast(pa.binary()).to_pylist(), [0, *ends[:-1]], ends, batch.column("__copy").to_pylist(), strict=True):
                parts = [] if value is None else value.split(b"\n")
                worded = [bool(x.strip()) for x in parts]  # of bytes, ``strip`` takes the six ASCII spaces
                out = {k for k, w in enumerate(worded) if w} if copy else set(numbers[begin:end])
                texts.append(value if not out else b"\n".join(x for k, x in enumerate(parts) if k not in out))
                counts.append(sum(worded))
                drops.append(len(out))
            new = {text: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(drops, pa.int64())}
            names = [*kept, "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return joined.select(*kept, "__gone", "__copy").mapInArrow(run, schema)
