"""A Merkle manifest of a table: a tree a source, a tree over their roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Of every three consecutive nodes of a level the next level holds the hash, until
one is left. Levels are made a tier (four of them) at a time: a task hashes the 81 nodes below one node of the next tier, so
that no group grows with the table, and the nodes are written as tables by coordinate (tree, level, place).

A proof is found by coordinates: from its place and the size of its tree a leaf knows where its siblings stand; it explodes
these coordinates within its tier, joins the node table, and orders and joins what it finds. Above the tier all 81 leaves
of a block share the rest of the proof, which the root of the block looks up in the same way, tier by tier, and so does the
root of a source in the tree over the sources. Thus a node near a root is looked up by its tier and not by all rows below it.

Edge cases: null fields have a mark of their own, apart from empty ones; a null source is a source and comes first, a null
id comes before all others and is never tampered with; rows of one id are ordered by their leaves, and rows that repeat
have equal leaves at places of their own; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, let, persist

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that are hashed together, levels of a tier, and leaves below a node of the next tier.
RUN, TIER = 3, 4
BLOCK = RUN**TIER
_STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each field as its number of bytes, a colon and its value; a null as a dash."""
    said = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(said(f.cast("string")) for f in fields)), 256)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _power(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(RUN**j).cast("long") for j in range(TIER + 1))), k + 1)


def _size(n: Column, k: Column) -> Column:
    """Nodes of a level, from those ``k`` levels below."""
    return _div(n + _power(k) - 1, _power(k))


def _levels(n: Column) -> Column:
    """How many of a tier's levels are needed to bring ``n`` nodes to one."""
    return F.size(F.filter(F.array(*(F.lit(RUN**j).cast("long") for j in range(TIER))), lambda p: p < n))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _placed(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """``rows`` sorted over all partitions and written, with the number of the partition and the place in it."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return persist(dealt.withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND((1 << 33) - 1)}), name)


def plant(rows: DataFrame, tree: str = "source", order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Numbers the ``rows`` (with a ``digest``) of each tree, and the trees: (rows with tree, idx, n; (tree, n)).

    Rows are dealt by ranges of all that orders them, so that a tree of a third of all rows is many tasks' work. A row's
    number is its place in its partition, less where its tree begins there, plus the tree's rows in earlier partitions.
    """
    keyed = rows.withColumns({"__tree": F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit("")), "__row": F.monotonically_increasing_id()})
    first = persist(keyed, "rows")
    placed = _placed(first, "placed", "__tree", order, "digest", "__row")
    runs = placed.groupBy("__tree", "part").agg(F.count("*").alias("__n"), F.min("place").alias("__from"))
    runs = runs.withColumn("__before", F.sum("__n").over(Window.partitionBy("__tree").orderBy("part")) - F.col("__n"))
    trees = _placed(runs.groupBy("__tree").agg(F.sum("__n").alias("n")), "trees", "__tree")
    sizes = {r[0]: r[1] for r in trees.groupBy("part").agg(F.count("*")).collect()}  # one number a partition
    starts, so_far = [], 0
    for part in sorted(sizes):
        starts.append((part, so_far))
        so_far += sizes[part]
    spark = rows.sparkSession
    numbered = trees.join(F.broadcast(spark.createDataFrame(starts, "part long, __start long")), "part").select("__tree", (F.col("__start") + F.col("place")).alias("tree"), "n")
    runs = runs.join(numbered, "__tree").select("__tree", "part", "tree", "n", (F.col("__before") - F.col("__from")).alias("__shift"))
    leaves = placed.join(runs, ["__tree", "part"]).withColumn("idx", F.col("place") + F.col("__shift")).drop("__tree", "__row", "__shift", "part", "place")
    leaves = persist(leaves, "leaves")
    for done in (first, placed):
        drop_scratch(spark, done)
    return leaves, numbered.select("tree", "n")


def _parents(level: Column) -> Column:
    starts = F.sequence(F.lit(0), _div(F.size(level) - 1, F.lit(RUN)).cast("int"))
    return F.transform(starts, lambda i: F.sha2(_joined(F.slice(level, i * RUN + 1, RUN)), 256))


def _tier(nodes: DataFrame) -> DataFrame:
    """The levels above ``nodes`` (tree, idx, n, digest): (tree, k, idx, n, digest), k from one; n counts the level's nodes."""
    blocks = nodes.groupBy("tree", _div(F.col("idx"), F.lit(BLOCK)).alias("block")).agg(F.first("n").alias("__n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("__x"))
    base = F.col("__x")["digest"]
    grown = F.aggregate(F.sequence(F.lit(1), _levels(F.col("__n"))), F.array(base), lambda done, _: F.concat(done, F.array(let(F.element_at(done, -1), _parents))))
    levels = blocks.select("tree", "block", "__n", F.posexplode(grown).alias("k", "__level")).where("k > 0")
    each = levels.select("tree", "k", F.col("block"), _size(F.col("__n"), F.col("k")).alias("n"), F.posexplode("__level").alias("__at", "digest"))
    return each.select("tree", F.col("k").cast("int").alias("k"), (F.col("block") * _power(F.lit(TIER) - F.col("k")) + F.col("__at")).alias("idx"), "n", "digest")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The node tables above ``leaves``, tier by tier, until every tree has one node left."""
    tiers: list[DataFrame] = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    rows = leaves
    while most > 1:
        tiers.append(persist(_tier(rows.where("n > 1").select("tree", "idx", "n", "digest")), "tier"))
        rows = tiers[-1].where(F.col("k") == TIER)
        most = -(-most // BLOCK)
    return tiers


def roots(leaves: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that is left of each tree; a lone leaf is its own."""
    found = leaves.where("n = 1").select("tree", "digest")
    for tier in tiers:
        found = found.unionByName(tier.where("n = 1").select("tree", "digest"))
    return found


def _coordinates() -> Column:
    """Where the siblings stand within the tier: (level above the tier's own, place), as the place and the tree's size say."""

    def at(k: Column) -> Column:
        own = _div(F.col("idx"), _power(k))
        run = own - F.pmod(own, F.lit(RUN))
        near = F.filter(F.array(*(run + j for j in range(RUN))), lambda x: (x != own) & (x < _size(F.col("n"), k)))
        return F.transform(near, lambda x: F.struct(k.alias("k"), x.alias("at")))

    return F.when(F.col("n") > 1, F.flatten(F.transform(F.sequence(F.lit(0), _levels(F.col("n")) - 1), at)))


def _steps(found: Column) -> Column:
    """What stands left and right of the way up, level by level; a level of a lone node has empty sides."""

    def step(k: Column) -> Column:
        here = F.filter(found, lambda f: f["k"] == k)
        own = _div(F.col("idx"), _power(k))
        side = lambda keep: _joined(F.transform(F.filter(here, keep), lambda f: f["digest"]))
        return F.struct(side(lambda f: f["at"] < own).alias("left"), side(lambda f: f["at"] > own).alias("right"))

    steps = F.transform(F.sequence(F.lit(0), _levels(F.col("n")) - 1), step)
    return F.when(F.col("n") > 1, steps).otherwise(F.array()).cast(_STEPS)


def prove(leaves: DataFrame, tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``leaves`` with their ``steps`` to the root; ``ends`` (tree, n, steps and more) is how it goes on above each tree.

    From the highest tier down: the rows of a tier join their own siblings with the steps of the node above their block.
    """
    above = None
    more = [c for c in ends.columns if c not in ("tree", "n", "steps")]
    for t in reversed(range(max(len(tiers), 1))):
        rows = leaves if t == 0 else tiers[t - 1].where(f"k = {TIER} AND n > 1").drop("k")
        own = [c for c in rows.columns if c not in ("tree", "idx", "n")]
        least, size = BLOCK**t if t else 0, BLOCK ** (t + 1)
        upper = ends.where((F.col("n") > least) & (F.col("n") <= size)).select("tree", F.lit(0).cast("long").alias("block"), F.col("steps").alias("__more"), *more)
        if above is not None:
            upper = upper.unionByName(above.select("tree", F.col("idx").alias("block"), F.col("steps").alias("__more"), *more))
        asked = rows.select("tree", "idx", "n", F.explode(_coordinates()).alias("__c")).select("tree", "idx", "n", "__c.*")
        nodes = rows.where("n > 1").select("tree", F.lit(0).alias("k"), F.col("idx").alias("at"), "digest")
        if tiers:
            nodes = nodes.unionByName(tiers[t].where(f"k < {TIER}").select("tree", "k", F.col("idx").alias("at"), "digest"))
        met = asked.join(nodes, ["tree", "k", "at"]).select("tree", "idx", "n", F.struct("k", "at", "digest").alias("__f"), F.lit(None).cast(rows.select(F.struct(*own)).schema[0].dataType).alias("__own"))
        whole = met.unionByName(rows.select("tree", "idx", "n", F.lit(None).cast(met.schema["__f"].dataType).alias("__f"), F.struct(*own).alias("__own")))
        by_block = whole.withColumn("block", _div(F.col("idx"), F.lit(BLOCK))).repartition("tree", "block")
        gathered = by_block.groupBy("tree", "block", "idx").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("__f")).alias("__found"), F.first("__own", ignorenulls=True).alias("__own"))
        local = gathered.select("tree", "block", "idx", "n", "__own.*", _steps(F.col("__found")).alias("__steps"))
        proven = local.join(upper, ["tree", "block"]).select("tree", "idx", "n", *own, F.concat("__steps", "__more").alias("steps"), *more)
        above = proven if t == 0 else persist(proven, "proofs")
    return above


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, digest, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, from the leaf to the root and left to right."""
    return _joined(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def verified(rows: DataFrame, tree: str = "source", order: str = "doc_id") -> DataFrame:
    """``rows`` (``digest``, and ``now``: the leaf as it is found today) with subroot, root, steps, folded_root and verified."""
    spark = rows.sparkSession
    leaves, trees = plant(rows, tree, order)
    tiers = grow(leaves)
    tops = persist(roots(leaves, tiers).withColumnRenamed("tree", "idx").withColumn("tree", F.lit(0).cast("long")).crossJoin(F.broadcast(trees.agg(F.count("*").alias("n")))), "tops")
    high = grow(tops)
    root = roots(tops, high).select("tree", F.col("digest").alias("root"))
    whole = tops.select("tree", "n").limit(1).join(root, "tree").withColumn("steps", F.array().cast(_STEPS))
    over = prove(tops, high, whole).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    ends = persist(trees.join(over, "tree"), "ends")
    for done in (tops, *high):
        drop_scratch(spark, done)
    found = prove(leaves, tiers, ends)
    return found.withColumn("folded_root", folded(F.col("now"), F.col("steps"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row's leaf, its tree's root, the root of all, and its proof, held against the row as it is tampered with.

    Where the checksum of the id is even the text loses its line ends; such rows without line ends stay as they are.
    """
    text = F.col("text")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    now = F.when(F.coalesce(even, F.lit(False)) & text.contains("\n"), F.translate(text, "\n", "")).otherwise(text)
    digest = leaf([F.col(c) for c in fields])
    changed = F.when(F.coalesce(even & text.contains("\n"), F.lit(False)), leaf([now if c == "text" else F.col(c) for c in fields]))
    rows = docs.select("doc_id", "source", digest.alias("digest"), changed.alias("__changed"))
    rows = rows.select("doc_id", "source", "digest", F.coalesce("__changed", "digest").alias("now"))
    found = verified(rows)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")
