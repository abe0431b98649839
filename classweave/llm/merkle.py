"""Merkle manifests of a table: a tree a group, and a tree over the groups' roots.

A row is a leaf, the digest of its columns. A group's leaves ascend by a key; every
``FANOUT`` nodes in a row make a node of the next level until one is left, the
group's root. The groups' roots, ascending by group, make the root likewise.

Nodes stand in aligned blocks of ``FANOUT ** BLOCK_LEVELS``. A block keeps each of
its levels as one string of hex digests of fixed width: a substring of ``FANOUT``
digests, hashed, is a digest of the level above, and what flanks a digest in its
substring are its siblings. A block's last digest is a node of the next round,
which works on blocks of blocks, so there are as many rounds as the number of
leaves has digits to the base of a block. A proof is put together on the way
back: a node's own siblings, then those of its block.

No group is ever in one task: leaves are placed by a sort over all of them, a
task holds a block at a time, and rounds shrink by the size of a block. Every
round is written, so a lost executor repeats one at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classweave.functions.running import ROW_BITS, global_rank
from classweave.session import materialise

DIGEST_CHARS = 64
FANOUT = 8
BLOCK_LEVELS = 3
BLOCK = FANOUT ** BLOCK_LEVELS
RUN_CHARS = FANOUT * DIGEST_CHARS

SIBLINGS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_column(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its bytes, ``:``, itself."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(
        F.when(t.isNull(), F.lit("-"))
        .otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts)))


def group_name(value: Column) -> Column:
    """A text without nulls that sorts as the values do by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


# --- levels -----------------------------------------------------------------

def _cut(text: Column, start: Column, width: Column | int) -> Column:
    return F.substr(text, start.cast("int"), F.lit(width) if isinstance(width, int) else width)


def next_level(level: Column) -> Column:
    """The digests of the level above, as one string."""
    runs = F.ceil(F.length(level) / RUN_CHARS)
    return F.array_join(F.transform(
        F.sequence(F.lit(0), runs.cast("int") - 1),
        lambda i: digest(_cut(level, i * RUN_CHARS + 1, RUN_CHARS))), "")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """One row a block of ``nodes`` (``tree, pos, digest, row``), with its levels.

    ``pos`` numbers the nodes of a tree from zero without gaps. The first block
    of a tree stops at the level that has one node; where there are more blocks,
    all of them are whole but the last, and all have every level.
    """
    found = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "row"))).alias("nodes"))
    n = F.size("nodes")
    height = F.lit(BLOCK_LEVELS)
    for level in range(BLOCK_LEVELS - 1, -1, -1):
        height = F.when((F.col("block") == 0) & (n <= FANOUT ** level), level).otherwise(height)
    found = found.select(
        "tree", "block", height.alias("height"),
        F.transform("nodes", lambda x: x["row"]).alias("rows"),
        F.array_join(F.transform("nodes", lambda x: x["digest"]), "").alias("level_0"))
    for level in range(1, BLOCK_LEVELS + 1):
        found = found.withColumn(f"level_{level}", F.when(
            F.col("height") >= level, next_level(F.col(f"level_{level - 1}"))))
    return found.withColumn("top", F.coalesce(
        *(f"level_{level}" for level in range(BLOCK_LEVELS, -1, -1))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every round, each written, up to one block a tree."""
    rounds = [materialise(blocks_of(nodes))]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        rounds.append(materialise(blocks_of(rounds[-1].select(
            "tree", F.col("block").alias("pos"), F.col("top").alias("digest"),
            F.lit(0).alias("row")))))
    return rounds


def _siblings(run: Column, slot: Column) -> Column:
    """What flanks a digest in its run."""
    return F.struct(
        F.substr(run, F.lit(1), (slot * DIGEST_CHARS).cast("int")).alias("left"),
        F.substr(run, ((slot + 1) * DIGEST_CHARS + 1).cast("int")).alias("right"))


def expand(blocks: DataFrame) -> DataFrame:
    """``tree, pos, row, digest, subroot, path`` of every node of blocks.

    A block brings ``above``, the siblings from its last digest on, and the
    ``subroot`` of its tree. ``path`` lists the siblings level by level.
    """
    runs = blocks.select(
        "tree", "block", "height", "subroot", "above",
        *(f"level_{level}" for level in range(1, BLOCK_LEVELS)),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FANOUT).cast("int")),
            lambda r: F.struct(
                _cut(F.col("level_0"), r * RUN_CHARS + 1, RUN_CHARS).alias("text"),
                F.slice("rows", r * FANOUT + 1, F.lit(FANOUT)).alias("rows"))
        )).alias("run", "own"))
    # the siblings above the run are those of all its nodes
    upper = []
    for level in range(1, BLOCK_LEVELS):
        at = F.floor(F.col("run") / FANOUT ** (level - 1)).cast("int")
        run = _cut(F.col(f"level_{level}"),
                   F.floor(at / FANOUT) * RUN_CHARS + 1, RUN_CHARS)
        upper.append(_siblings(run, at % FANOUT))
    runs = runs.select(
        "tree", "block", "height", "subroot", "run", "own",
        F.concat(F.slice(F.array(*upper), F.lit(1), F.greatest(F.col("height") - 1, F.lit(0))),
                 "above").alias("upper"))
    nodes = runs.select(
        "tree", "block", "height", "subroot", "run", "upper", F.col("own.text").alias("text"),
        F.posexplode("own.rows").alias("slot", "row"))
    own = F.when(F.col("height") > 0, F.array(_siblings(F.col("text"), F.col("slot")))
                 ).otherwise(F.array().cast(SIBLINGS))
    return nodes.select(
        "tree", (F.col("block") * BLOCK + F.col("run") * FANOUT + F.col("slot")).alias("pos"),
        "row", _cut(F.col("text"), F.col("slot") * DIGEST_CHARS + 1, DIGEST_CHARS).alias("digest"),
        "subroot", F.concat(own, "upper").alias("path"))


def descend(rounds: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """``expand`` of the first round; ``tops`` has ``above, subroot`` of every tree."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        above = materialise(expand(blocks.join(above, ["tree", "block"])).select(
            "tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot"))
    return expand(rounds[0].join(above, ["tree", "block"]))


# --- the manifest -----------------------------------------------------------

def place(leaves: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree`` in the order of unique keys.

    A sorted and written partition is a stretch of the order. The place in the
    stretch, less where the tree starts in it, plus the tree's rows in earlier
    stretches is the place in the tree. The offsets have a row for each stretch
    and tree, so that joining them deals out a large tree by its stretches.
    """
    placed = materialise(leaves.orderBy("tree", *order).withColumn(
        "at", F.monotonically_increasing_id())).withColumns({
            "stretch": F.shiftright("at", ROW_BITS),
            "row_number": F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    before = Window.partitionBy("tree").orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.groupBy("tree", "stretch").agg(
        F.count("*").alias("n"), F.min("row_number").alias("first")).select(
        "tree", "stretch",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(offsets, ["tree", "stretch"]).withColumn(
        "pos", F.col("row_number") + F.col("offset"))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str,
             **carried: Column) -> DataFrame:
    """``key, group, leaf, subroot, root, path`` and ``carried`` for every row.

    Leaves are digests of ``columns``. A group's leaves ascend by ``key``, null
    first; rows of one key follow by their leaf, so only equal rows may change
    places. Null groups are one group, the first. ``path`` has the siblings of
    every level, ``left`` and ``right`` of the node as hex text, up to the root; it
    is empty for the only row of a table. Repeated rows are leaves of their own.
    Other columns of ``docs`` take no part, and a table without rows gives none.
    """
    leaves = materialise(docs.select(
        group_name(F.col(group)).alias("tree"), F.col(key).alias("key"),
        leaf_column([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.col(key).alias("key"), F.col(group).alias("group"),
                 *(c.alias(n) for n, c in carried.items())).alias("row"),
        # tells equal rows apart, so that no number of them lands in one task
        F.monotonically_increasing_id().alias("at")))
    rounds = climb(place(leaves, ["key", "digest", "at"]))
    subroots = rounds[-1].select("tree", F.col("top").alias("subroot"))
    forest = climb(global_rank(subroots, ["tree"], "pos").select(
        F.lit("").alias("tree"), "pos", F.col("subroot").alias("digest"),
        F.struct("tree").alias("row")))
    top = forest[-1].select("top").first()
    root = top["top"] if top else None
    over = forest[-1].select("tree").distinct().select(
        "tree", F.array().cast(SIBLINGS).alias("above"),
        F.lit(None).cast("string").alias("subroot"))
    tops = materialise(descend(forest, over).select(
        F.col("row.tree").alias("tree"), F.col("path").alias("above"),
        F.col("digest").alias("subroot")))
    return descend(rounds, tops).select(
        F.col("row.key").alias(key), F.col("row.group").alias(group),
        F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        "path", *(F.col(f"row.{n}").alias(n) for n in carried))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, in order."""
    return digest(F.array_join(F.transform(
        path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(
        path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))
