"""BM25 and vector rankings, their fusion by reciprocal rank, and the results."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.text import query_phrases, snippet, tokens

POOL, RRF_K, TOP = 50, 60, 8
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand side by side."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))
    fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == t for k, t in enumerate(phrase)])
    return F.when(F.size(words) >= len(phrase), F.size(F.filter(starts, fits))).otherwise(0)


#: Chunks of one part are alike in length (four classes an octave); each class is dealt into so many parts by id.
DEALS = 64


class Postings(NamedTuple):
    """An inverted index: (token, id, kind, length, positions, part), and rows of (chunks, length) that add up to its totals.

    ``tops`` says of each token, part and kind how many chunks have it, how often at most, and how short the shortest is.
    """

    rows: DataFrame
    totals: DataFrame
    tops: DataFrame | None = None


def part_of(length: Column, id_: Column) -> Column:
    """Chunks of a part are alike in length, so that the greatest score in it is near what the others can have."""
    octave = F.floor(4 * F.log2(length.cast("double") + 1)).cast("int")
    return octave * DEALS + F.pmod(F.xxhash64(id_), F.lit(DEALS)).cast("int")


def tops_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token", "part", "kind").agg(F.count("*").alias("n"), F.max(F.size("positions")).alias("most"), F.min("length").alias("least"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, kind, length, part, positions): the tokens of each chunk with their places."""
    for batch in batches:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        sizes = np.asarray(pc.list_value_length(words))
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        both = row * len(coded.dictionary) + np.asarray(coded.indices)
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
        of, at = order[first], pa.array(row[order[first]])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(place[order]))
        token = coded.dictionary.take(coded.indices.take(pa.array(of)))
        yield pa.RecordBatch.from_arrays([token, *(batch.column(c).take(at) for c in ("part", "id", "kind", "length")), positions], names=["token", "part", "id", "kind", "length", "positions"])


def postings_of(chunks: DataFrame) -> Postings:
    """One row a token and chunk, made inside the chunk's row, so that nothing is shuffled; see ``in_ranges`` for how they are stored.

    Chunks need an id of their own; a null text has no tokens, but counts as a chunk.
    """
    counts = lambda w: F.struct(F.size(w).alias("length"), w.alias("words"))
    cut = chunks.select("id", "kind", once(tokens("text"), counts).alias("__c")).select("id", "kind", "__c.*")
    parted = cut.select("id", "kind", "length", part_of(F.col("length"), F.col("id")).alias("part"), "words")
    rows = parted.mapInArrow(_places, f"token string, part int, id {chunks.schema['id'].dataType.simpleString()}, kind string, length int, positions array<int>")
    return Postings(rows, cut.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("length")), tops_of(rows))


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows as they are stored: ranges of (token, part, id) split a frequent token by chunk; a partition holds neighbouring tokens, sorted.

    ``rows`` come from a table, as a sample of them is taken first.
    """
    return rows.repartitionByRange("token", "part", "id").sortWithinPartitions("token", "part", "id")


def _phrase_places(places: dict[str, Column], phrase: list[str]) -> Column:
    """How often a phrase occurs, from the places of each of its tokens (null: none)."""
    moved = lambda k: F.transform(places[phrase[k]], lambda x: x - k)
    starts = reduce(F.array_intersect, [moved(k) for k in range(1, len(phrase))], places[phrase[0]])
    return F.coalesce(F.array_size(starts), F.lit(0))


def bm25_postings(postings: Postings, query: str, kind: str | None = None) -> DataFrame:
    """``bm25`` from postings: only those of the query's tokens are read, and none of the texts."""
    phrases = query_phrases(query)
    if not phrases:
        return postings.rows.where("false").select("id", F.lit(0.0).alias("bm25"))
    held = sorted({t for p in phrases for t in p})
    rows = postings.rows.where(F.col("token").isin(held))
    places = [F.max(F.when(F.col("token") == t, F.col("positions"))).alias(f"__at{k}") for k, t in enumerate(held)]
    at = {t: F.col(f"__at{k}") for k, t in enumerate(held)}
    met = rows.groupBy("id").agg(F.first("kind").alias("kind"), F.first("length").cast("double").alias("__len"), *places)
    counted = met.select("id", "kind", "__len", *(_phrase_places(at, p).cast("double").alias(f"__tf{k}") for k, p in enumerate(phrases)))
    n = F.sum("chunks").cast("double")
    totals = postings.totals.agg(n.alias("__n"), F.try_divide(F.sum("length"), n).alias("__avg"))
    return _scores(counted, totals.crossJoin(counted.agg(*_found_in(len(phrases)))), len(phrases), kind)


def _idf(n: float, df: float) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def _ranges(parts: list[int], every: list[int]) -> Column:
    """A condition that reads ``parts``: runs of them, without others of ``every`` between, as comparisons that reach the scan."""
    place = {p: k for k, p in enumerate(sorted(every))}
    runs: list[list[int]] = []
    for p in sorted(parts):
        if runs and place[p] == place[runs[-1][1]] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    if len(runs) > 64:
        return F.col("part").isin(parts)
    return reduce(lambda a, b: a | b, [F.col("part").between(low, high) for low, high in runs], F.lit(False))


class Pruned(NamedTuple):
    """The k best, and the parts that were read of those that hold a token of the query."""

    found: DataFrame
    read: list[int]
    parts: list[int]


def bm25_best(postings: Postings, query: str, k: int = POOL, kind: str | None = None) -> Pruned:
    """The k best by ``bm25_postings``, without reading parts that cannot hold one of them.

    A part's bound is what a chunk of it scored if it had each token as often as any and were as short as any. The parts of the
    greatest bounds are scored first; the k-th best score there rules out all parts whose bound is below it. Statistics of
    single tokens are sums of ``tops``. A query with a phrase of several tokens reads all its postings, as only
    these tell how many chunks hold the phrase.
    """
    phrases = query_phrases(query)
    if postings.tops is None or not phrases or any(len(p) > 1 for p in phrases):
        return Pruned(bm25_postings(postings, query, kind).orderBy("bm25", "id").limit(k), [], [])
    asked: dict[str, int] = {}
    for (token,) in phrases:
        asked[token] = asked.get(token, 0) + 1
    n, length = postings.totals.agg(F.sum("chunks"), F.sum("length")).first()
    tops = postings.tops.where(F.col("token").isin(list(asked)))
    df = {r[0]: float(r[1]) for r in tops.groupBy("token").agg(F.sum("n")).collect()}  # one number a token of the query
    if not df:
        return Pruned(postings.rows.where("false").select("id", F.lit(0.0).alias("bm25")), [], [])
    n, mean = float(n), float(length) / float(n)
    weight = F.create_map(*(c for t in df for c in (F.lit(t), F.lit(asked[t] * _idf(n, df[t])))))[F.col("token")]
    score = lambda tf, size: weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    held = tops if kind is None else tops.where(F.col("kind") == kind)
    by_token = held.groupBy("part", "token").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n"))
    by_part = by_token.groupBy("part").agg(F.sum(score(F.col("most").cast("double"), F.col("least").cast("double"))).alias("bound"), F.max("n").alias("n"))
    bounds = sorted(((r[1], r[0], r[2]) for r in by_part.collect()), reverse=True)  # classes of length times deals at most
    first, chunks = 0, 0
    while first < len(bounds) and chunks < k:
        chunks += bounds[first][2]
        first += 1
    every = [p for _, p, _ in bounds]

    def scored(parts: list[int]) -> DataFrame:
        rows = postings.rows.where(F.col("token").isin(list(df)) & _ranges(parts, every))
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        return rows.groupBy("id").agg((-F.sum(score(F.size("positions").cast("double"), F.col("length").cast("double")))).alias("bm25")).orderBy("bm25", "id").limit(k)

    begun = scored(every[:first]).collect()  # k rows at most
    least = -begun[-1]["bm25"] if len(begun) == k else 0.0
    read = [p for at, (bound, p, _) in enumerate(bounds) if at < first or bound >= least * (1 - 1e-9)]
    return Pruned(scored(read), read, every)


def bm25(chunks: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """(id, bm25) of chunks with any phrase of the query; lower is better. Without postings: two scans of the texts, one for the statistics.

    Statistics are over all chunks, also when a kind is asked for. They are one row of a few numbers, the
    only thing that is broadcast.
    """
    phrases = query_phrases(query)
    count = lambda w: F.struct(F.size(w).cast("double").alias("__len"), *(_phrase_count(w, p).cast("double").alias(f"__tf{k}") for k, p in enumerate(phrases)))
    counted = chunks.select("id", "kind", once(tokens("text"), count).alias("__c")).select("id", "kind", "__c.*")
    n = F.count("*").cast("double")
    return _scores(counted, counted.agg(n.alias("__n"), F.try_divide(F.sum("__len"), n).alias("__avg"), *_found_in(len(phrases))), len(phrases), kind)


def _found_in(phrases: int) -> list[Column]:
    """In how many chunks each phrase occurs."""
    return [F.sum(F.when(F.col(f"__tf{k}") > 0, 1.0).otherwise(0.0)).alias(f"__df{k}") for k in range(phrases)]


def _scores(counted: DataFrame, totals: DataFrame, phrases: int, kind: str | None) -> DataFrame:
    """(id, bm25) from (id, kind, __len, __tf<k>) and one row: the number of chunks, their mean length, and how many hold each phrase."""
    if not phrases:
        return counted.where("false").select("id", F.lit(0.0).alias("bm25"))
    hit = reduce(lambda a, b: a | b, [F.col(f"__tf{k}") > 0 for k in range(phrases)])
    found = counted.where(hit if kind is None else hit & (F.col("kind") == kind)).crossJoin(F.broadcast(totals))

    def part(k: int) -> Column:
        tf, df = F.col(f"__tf{k}"), F.col(f"__df{k}")
        idf = F.greatest(F.log((F.col("__n") - df + F.lit(0.5)) / (df + F.lit(0.5))), F.lit(LEAST_IDF))
        return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__len") / F.col("__avg")))

    return found.select("id", (-reduce(lambda a, b: a + b, [part(k) for k in range(phrases)])).alias("bm25"))


def distance(vector: str, query: list[float]) -> Column:
    """Euclidean distance in double precision."""
    target = F.array(*(F.lit(float(x)) for x in query))
    squares = F.zip_with(F.col(vector), target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def knn(vectors: DataFrame, query: list[float], k: int = POOL, vector: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest, exactly; partitions keep their own k before the merge."""
    fit = vectors.where(F.size(vector) == len(query))
    return fit.select("id", distance(vector, query).alias("distance")).orderBy("distance", "id").limit(k)


# ---- nearest vectors behind pivots ------------------------------------------------------------------
#
# Vectors are stored by cell: each belongs to the pivot that it is nearest to, at a distance r. By the triangle inequality a
# vector of a cell with distances from r0 to r1 is no nearer to the query than max(0, d - r1, r0 - d), d being the pivot's distance
# to the query. Rings of a cell that lie beyond the k-th best so far are not read, and the result is exact.

#: Rings of a cell, by the distance to its pivot in steps of a sixteenth.
RING = 0.0625


def pivots_of(vectors: DataFrame, count: int = 64, vector: str = "embedding") -> list[list[float]]:
    """So many vectors, drawn by the hash of their ids; more than that is never collected."""
    near = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64("id").alias("__h"), F.col(vector).alias("v")).orderBy("__h").limit(count)
    return [[float(x) for x in r["v"]] for r in near.collect()]


def celled(vectors: DataFrame, pivots: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Adds ``cell`` and ``ring``, and sorts by them, so that a file's row groups hold neighbouring rings."""
    apart = [F.struct(distance(vector, p).alias("r"), F.lit(k).alias("cell")) for k, p in enumerate(pivots)]
    nearest = F.array_min(F.array(*apart))
    placed = vectors.where(F.size(vector) == len(pivots[0])).withColumn("__n", nearest)
    rings = placed.withColumns({"cell": F.col("__n")["cell"], "ring": F.floor(F.col("__n")["r"] / RING).cast("int")}).drop("__n")
    return rings.repartitionByRange("cell", "ring", "id").sortWithinPartitions("cell", "ring", "id")


def rings_of(cells: DataFrame) -> DataFrame:
    """(cell, ring, n): how many vectors lie where."""
    return cells.groupBy("cell", "ring").agg(F.count("*").alias("n"))


def knn_best(cells: DataFrame, rings: DataFrame, pivots: list[list[float]], query: list[float], k: int = POOL, vector: str = "embedding") -> tuple[DataFrame, float]:
    """The k nearest exactly, as ``knn``, and the share of the vectors that was read for them."""
    d = [math.dist(p, query) for p in pivots]
    known = []
    for cell, ring, n in rings.collect():  # cells times rings, which distances of unit vectors bound
        low, high = ring * RING, (ring + 1) * RING
        known.append((max(0.0, d[cell] - high, low - d[cell]), cell, ring, n))
    known.sort()
    first, held = 0, 0
    while first < len(known) and held < k:
        held += known[first][3]
        first += 1

    def of(chosen: list[tuple]) -> DataFrame:
        by_cell: dict[int, list[int]] = {}
        for _, cell, ring, _ in chosen:
            by_cell.setdefault(cell, []).append(ring)
        inside = [(F.col("cell") == c) & F.col("ring").between(min(r), max(r)) & F.col("ring").isin(r) for c, r in sorted(by_cell.items())]
        return knn(cells.where(reduce(lambda a, b: a | b, inside, F.lit(False))), query, k, vector)

    begun = of(known[:first]).collect()  # k rows at most
    far = begun[-1]["distance"] if len(begun) == k else math.inf
    read = [x for at, x in enumerate(known) if at < first or x[0] <= far + 1e-6]
    total = sum(x[3] for x in known)
    return of(read), sum(x[3] for x in read) / max(total, 1)


def ranked(found: DataFrame, by: str) -> DataFrame:
    """Adds ``rank`` from 1 to a list that is already cut to the pool."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(by, "id")))


def fuse(vector_ranks: DataFrame, text_ranks: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score, vector_rank, text_rank): reciprocal ranks added; each input has id and rank."""
    v = vector_ranks.select("id", F.col("rank").alias("v"), F.lit(None).cast("int").alias("t"))
    t = text_ranks.select("id", F.lit(None).cast("int").alias("v"), F.col("rank").alias("t"))
    both = v.unionByName(t).groupBy("id").agg(F.min("v").alias("vector_rank"), F.min("t").alias("text_rank"))
    share = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    return both.select("id", (share("vector_rank") + share("text_rank")).alias("score"), "vector_rank", "text_rank")


ORDER = (F.desc, "score"), (F.asc_nulls_last, "vector_rank"), (F.asc_nulls_last, "text_rank"), (F.asc, "id")


def pools(
    chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], kind: str | None = None, pool: int = POOL, postings: Postings | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both rankings, each cut to the pool. A kind is applied before that, so rare kinds fill their pool."""
    if kind is not None:
        vectors = vectors.join(chunks.where(F.col("kind") == kind).select("id"), "id", "left_semi")
    said = bm25(chunks, query, kind).orderBy("bm25", "id").limit(pool) if postings is None else bm25_best(postings, query, pool, kind).found
    return ranked(knn(vectors, query_vector, pool), "distance"), ranked(said, "bm25")


def hybrid(
    chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int = TOP, kind: str | None = None, pool: int = POOL, postings: Postings | None = None
) -> DataFrame:
    """The k best chunks by fused rank, with the columns of a search result. A pool holds k at least."""
    return best(chunks, *pools(chunks, vectors, query, query_vector, kind, max(pool, k), postings), k)


def best(chunks: DataFrame, near: DataFrame, said: DataFrame, k: int = TOP) -> DataFrame:
    """The k best of two ranked pools; at most their ids meet the chunks, as the broadcast side of one join."""
    hits = chunks.join(F.broadcast(fuse(near, said)), "id")
    order = [f(c) for f, c in ORDER]
    top = hits.orderBy(*order).limit(max(k, 1))
    return top.select("id", F.round("score", 4).alias("score"), "kind", F.col("ts_start").alias("ts"), "app", "window", "url", "n_frames", snippet("text").alias("snippet"))


def as_text(rows: list, query: str, n_vector: int, n_text: int) -> str:
    """The results as the command line prints them."""
    out = [f"Query: {query!r}  (vec={n_vector} + fts={n_text})"]
    for place, r in enumerate(rows, 1):
        out.append(f"[{place}] {r['score']}  <{r['kind']}>  {r['ts']}  {r['app'] or '?'} / {r['window'] or '?'}")
        out.extend([f"     {r['url']}"] if r["url"] else [])
        out.append("     " + r["snippet"].replace("\n", " "))
    return "\n".join(out)
