"""Near-duplicate embeddings by collision-counting projections.

Every vector is projected on ``PROJECTIONS`` random directions. Two vectors
collide in a projection if one lies in the window centred on the other; the
window's half width is ``WIDTH`` times the distance of two unit vectors at the
threshold, so such a pair collides in each projection with a known chance. Pairs
are verified by their exact cosine if they collide often enough, and the counts
asked for are set from the binomial distribution so that a pair at the threshold
is missed with a chance below ``MISS``; nearer pairs collide more often.

Vectors are compared within a label and length. Equal vectors are taken once.
A label's vectors are dealt by hash into tiles of about ``TILE_BYTES``, and each
pair of tiles is one group for one task, so a hot label is many small groups. In
a task every projection is sorted, so that a vector's window is a run of ranks;
whether a rank lies in the run is one comparison of small integers, which counts
the collisions of all pairs of a strip at once. Only pairs whose first projections
are within reach of each other are looked at. A task returns counts per vector and
a forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.components import components
from classweave.session import materialise

THRESHOLD = 0.93
PROJECTIONS = 48
WIDTH = 1.5
MISS = 1e-6
SEED = 20_240_229
TILE_BYTES = 2_000_000
# pairs whose collisions are counted at once
STRIP_PAIRS = 500_000

COUNTS_TYPE = "class long, linked long, least long"


def directions(length: int) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng([SEED, length]).standard_normal((length, PROJECTIONS))


def collision_chance() -> float:
    """Of a pair at the threshold, in one projection."""
    return math.erf(WIDTH / math.sqrt(2))


def wanted_count(trials: int, miss: float) -> int:
    """The largest count reached with a chance of at least ``1 - miss``."""
    p, below = collision_chance(), 0.0
    for count in range(trials + 1):
        below += math.comb(trials, count) * p ** count * (1 - p) ** (trials - count)
        if below > miss:
            return count
    return trials


def rank_windows(left: np.ndarray, right: np.ndarray,
                 half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of ``right`` in one projection, and ``left``'s windows as first rank and width."""
    order = np.argsort(right, kind="stable")
    values = right[order]
    kind = np.uint16 if len(right) < 1 << 16 else np.uint32
    rank = np.empty(len(right), kind)
    rank[order] = np.arange(len(right), dtype=kind)
    first = np.searchsorted(values, left - half, "left")
    last = np.searchsorted(values, left + half, "right")
    return rank, first.astype(kind), (last - first).astype(kind)


def candidate_pairs(left: np.ndarray, right: np.ndarray,
                    half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that collide often enough; rows hold the projections.

    Both sides are sorted by their first projection. Of a strip of ``left`` only
    the stretch of ``right`` that its widest reach holds is looked at.
    """
    every = wanted_count(PROJECTIONS, MISS / 2)
    # one projection alone may miss; as a bound it is wide enough not to
    reach = half / WIDTH * 6.0
    windows = [rank_windows(left[:, j], right[:, j], half) for j in range(PROJECTIONS)]
    rows = max(1, STRIP_PAIRS // max(len(right), 1))
    for low in range(0, len(left), rows):
        own = slice(low, min(low + rows, len(left)))
        start = np.searchsorted(right[:, 0], left[low, 0] - reach, "left")
        stop = np.searchsorted(right[:, 0], left[own.stop - 1, 0] + reach, "right")
        if start == stop:
            continue
        counts = np.zeros((own.stop - low, stop - start), np.uint8)
        for rank, first, width in windows:
            # ranks before the window wrap round to large numbers
            place = rank[None, start:stop] - first[own, None]
            counts += (place < width[own, None]).view(np.uint8)
        a, b = np.nonzero(counts >= every)
        if len(a):
            yield low + a, start + b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over links a-b."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        before = least.copy()
        # hang roots, not only rows, on the smaller end
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        while (jumped := least[least] != least).any():
            least = np.where(jumped, least[least], least)
        if (least == before).all():
            break
    return least


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def compare_tiles(classes: np.ndarray, copies: np.ndarray, tile: np.ndarray,
                  vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of each class in this pair of tiles, and its smallest class.

    Rows of one tile are compared with each other if there is one tile only,
    else with those of the other.
    """
    order = np.argsort(classes, kind="stable")  # rows stand for classes in order
    classes, copies, tile, vectors = (
        x[order] for x in (classes, copies, tile, vectors))
    unit = _unit(vectors)
    half = WIDTH * math.sqrt(2 * (1 - threshold))
    projected = (unit @ directions(unit.shape[1])).astype(np.float32)
    tiles = np.unique(tile)
    own = len(tiles) == 1
    sides = [np.flatnonzero(tile == t) for t in (tiles[0], tiles[-1])]
    sides = [s[np.argsort(projected[s, 0], kind="stable")] for s in sides]
    linked = np.zeros(len(classes), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    # half precision of a projection is far below the slack of the window
    for a, b in candidate_pairs(projected[sides[0]], projected[sides[1]], half + 1e-4):
        a, b = sides[0][a], sides[1][b]
        if own:
            a, b = a[a < b], b[a < b]
        for low in range(0, len(a), 65_536):
            x, y = a[low:low + 65_536], b[low:low + 65_536]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(linked, x, copies[y])
            np.add.at(linked, y, copies[x])
            # a strip's links shrink to a forest before the next is read
            if len(x):
                ends.append((x, y))
        if sum(len(x) for x, _ in ends) > 200_000:
            ends = [_as_forest(len(classes), ends)]
    least = forest(len(classes), *(
        np.concatenate(side) for side in zip(*ends))) if ends else np.arange(len(classes))
    return linked[np.argsort(order)], classes[least][np.argsort(order)]


def _as_forest(n: int, ends: list) -> tuple[np.ndarray, np.ndarray]:
    least = forest(n, *(np.concatenate(side) for side in zip(*ends)))
    own = np.flatnonzero(least != np.arange(n))
    return own, least[own]


def is_usable(vector: Column) -> Column:
    """Not null, and every component a finite number, not all of them zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(
        vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def tile_groups(classes: DataFrame) -> DataFrame:
    """Each class once for every pair of tiles that its own tile is part of.

    A (label, length) has as many tiles as its bytes ask for; labels of a single
    tile, which most are, need no count of their own.
    """
    size = F.greatest(F.lit(1), F.lit(TILE_BYTES) / (F.col("length") * 8)).cast("long")
    many = classes.groupBy("label", "length").agg(F.count("*").alias("rows")).withColumn(
        "tiles", F.ceil(F.col("rows") / size)).where("tiles > 1").drop("rows")
    return classes.join(many, ["label", "length"], "left").withColumn(
        "tiles", F.coalesce("tiles", F.lit(1))).withColumn(
        "tile", F.pmod(F.xxhash64("class"), F.col("tiles"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "length", F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"), "tile", "class", "copies", "vector")


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Reads ``vec_id, embedding, label``. Rows with a null label or an embedding
    that is null, empty, zero or not finite link with nothing. Every row counts
    as a vector, repeated rows too. The component is the smallest vec_id reached,
    nulls last, and is null where none has one.
    """
    base = rows.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & is_usable(F.col("vector"))
    base = base.withColumn(
        "vector", F.when(usable, F.col("vector")))
    held = base.where("vector is not null")
    # one row for equal vectors, counted before the shuffle
    grouped = materialise(held.groupBy("label", "vector").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    # written once, so that the numbers stay
    classes = materialise(grouped.select(
        F.monotonically_increasing_id().alias("class"), "label",
        F.size("vector").cast("long").alias("length"), "vector", "copies", "least"))

    def compare(table: pa.Table) -> pa.Table:
        vectors = np.array(table["vector"].combine_chunks().flatten()).reshape(
            table.num_rows, -1)
        own = table["class"].to_numpy()
        linked, least = compare_tiles(
            own, table["copies"].to_numpy(), table["tile"].to_numpy(), vectors, threshold)
        return pa.table({"class": own, "linked": linked, "least": least})

    found = materialise(tile_groups(classes).groupBy(
        "label", "length", "low", "high").applyInArrow(compare, COUNTS_TYPE))
    counted = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    joined = components(found.where("class <> least").select(
        F.col("class").alias("a"), F.col("least").alias("b")))
    parts = classes.join(counted, "class").join(
        joined.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    smallest = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    known = parts.join(smallest, "component").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id")
    done = held.join(known, (F.col("label") == F.col("_label")) & (
        F.col("vector") == F.col("_vector"))).select(
        "vec_id", "n_links", "component_id")
    alone = base.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
