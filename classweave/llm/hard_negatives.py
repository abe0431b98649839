"""Hard negatives: rows of another label that score nearly as high as a positive.

A score is the inner product of two vectors scaled to whole numbers. An anchor's
positives are its best rows of its own label; a positive's hard negatives are the
best rows of other labels whose score is at least ``least`` parts of ``whole`` of
the positive's and not above it. Higher scores come first, ties by smaller id.

Every vector is stored with the mean and the deviation of its segments, for each
of ``LEVELS`` numbers of segments; the deviation is the length of what the mean
leaves over. Over two segments of ``w`` components the inner product is ``w`` times
the product of the means, give or take at most the product of the deviations.
Summed over segments that bounds a score, more closely with more segments. A pair
is refined level by level while its bounds still allow it a place among the best
found so far; only what is left is scored. Bounds never decide alone, so the
result is exact.

Rows and anchors are dealt by hash into tiles of bounded size, and each pair of
tiles is one group for one task. A task returns its best rows of each anchor, and
ranking takes the best of those on each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classweave.session import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST, WHOLE = 80, 100
LEVELS = (1, 4, 16)
# squared lengths below this keep every score, and every part of it, a long
LONGEST = float(1 << 62)
# whole numbers below this are exact as doubles
EXACT = float(1 << 53)

ROW_TILE_BYTES = 2_000_000
ANCHOR_TILE_BYTES = 16_000_000
# pairs looked at together in a task
STRIP_PAIRS = 2_000_000
# below this share of a strip its pairs are taken one by one
SPARSE = 0.05

PREPARED = "struct<vector:array<double>,means:array<double>,deviations:array<double>>"
FOUND = "anchor long, slot int, partner long, id long, score long"


# --- vectors and their summaries --------------------------------------------

def segments(length: int, level: int) -> np.ndarray:
    """Where the segments of a level start; none is empty."""
    count = min(level, length)
    return np.arange(count) * length // max(count, 1)


def widths(length: int, level: int) -> np.ndarray:
    return np.diff(np.append(segments(length, level), length))


def summary(vectors: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment, a row a vector."""
    length = vectors.shape[1]
    starts, width = segments(length, level), widths(length, level)
    if not len(starts):
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    means = np.add.reduceat(vectors, starts, axis=1) / width
    rest = vectors - np.repeat(means, width, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def scaled_row(values: np.ndarray) -> np.ndarray | None:
    """Whole numbers, or None for a vector that takes no part."""
    if not np.isfinite(values).all():
        return None
    with np.errstate(over="ignore"):
        found = np.floor(values.astype(np.float64) * SCALE)
        return found if (found * found).sum() < LONGEST else None


def prepare(vectors: pa.Array) -> pa.Array:
    """``PREPARED`` of each vector; null where it takes no part."""
    out = []
    for vector in vectors:
        values = vector.values
        row = None if values is None or values.null_count else scaled_row(
            values.to_numpy(zero_copy_only=False))
        if row is None:
            out.append(None)
            continue
        parts = [summary(row[None], level) for level in LEVELS]
        out.append({"vector": row,
                    "means": np.concatenate([m[0] for m, _ in parts]),
                    "deviations": np.concatenate([d[0] for _, d in parts])})
    doubles = pa.list_(pa.float64())
    return pa.array(out, pa.struct([
        ("vector", doubles), ("means", doubles), ("deviations", doubles)]))


# --- the best rows of a pair of tiles ---------------------------------------

@dataclass(frozen=True)
class Side:
    """Vectors of one length, with what a pair is judged by."""

    row: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @property
    def longest(self) -> float:
        return float(np.sqrt((self.vectors * self.vectors).sum(1).max(initial=0)))

    def take(self, at) -> Side:
        return Side(self.row[at], self.ids[at], self.known[at], self.label[at],
                    self.vectors[at], [(m[at], d[at]) for m, d in self.levels])


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy().reshape(len(rows), -1)


def sides(table: pa.Table) -> Iterator[tuple[int, np.ndarray, Side]]:
    """A tile by vector length: the length, the rows' places, the vectors."""
    table = table.combine_chunks()

    def column(name: str) -> pa.Array:
        return table[name].combine_chunks()

    vectors, known = column("vector"), column("id").is_valid().to_numpy(zero_copy_only=False)
    ids = column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
    row, label = column("row").to_numpy(), column("label").to_numpy()
    lengths = vectors.value_lengths().to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        ends = np.cumsum([len(segments(length, level)) for level in LEVELS])[:-1]
        means = np.split(_matrix(column("means"), at), ends, axis=1) if length else []
        rest = np.split(_matrix(column("deviations"), at), ends, axis=1) if length else []
        yield int(length), at, Side(
            row[at], ids[at], known[at], label[at],
            _matrix(vectors, at) if length else np.zeros((len(at), 0)),
            list(zip(means, rest)))


def _bounds(level: int, length: int, a: Side, b: Side, at: tuple | None
            ) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the scores, of all pairs or of those in ``at``."""
    (mean_a, rest_a), (mean_b, rest_b) = a.levels[level], b.levels[level]
    weighed = mean_a * widths(length, LEVELS[level])
    if at is None:
        return weighed @ mean_b.T, rest_a @ rest_b.T
    i, j = at
    return (np.einsum("ij,ij->i", weighed[i], mean_b[j]),
            np.einsum("ij,ij->i", rest_a[i], rest_b[j]))


def _scores(a: Side, b: Side, at: tuple | None) -> np.ndarray:
    x, y = a.vectors, b.vectors
    if a.longest * b.longest >= EXACT:
        x, y = x.astype(np.int64), y.astype(np.int64)
    found = x @ y.T if at is None else np.einsum("ij,ij->i", x[at[0]], y[at[1]])
    return found.astype(np.int64)


def possible(length: int, a: Side, b: Side, same: bool,
             low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose score may lie in their anchor's ``low`` to ``high``, and the scores."""
    need = (a.label[:, None] == b.label[None]) == same
    need &= ~(b.known[None] & (a.ids[:, None] == b.ids[None]))
    slack = 1e-9 * a.longest * b.longest + 1e-6
    least, most = low - slack, high + slack
    at = None
    for level in range(len(a.levels)):
        if at is None and np.count_nonzero(need) <= SPARSE * need.size:
            at = np.nonzero(need)
        if at is not None and not len(at[0]):
            break
        middle, half = _bounds(level, length, a, b, at)
        if at is None:
            need &= (middle + half >= least[:, None]) & (middle - half <= most[:, None])
        else:
            kept = (middle + half >= least[at[0]]) & (middle - half <= most[at[0]])
            at = at[0][kept], at[1][kept]
    if at is not None:
        return (*at, _scores(a, b, at))
    i, j = np.nonzero(need)
    return i, j, _scores(a, b, None)[i, j]


def best_rows(length: int, a: Side, b: Side, same: bool, low: np.ndarray,
              high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of ``b`` for every group: group, place in ``b``, score.

    ``low`` and ``high`` have a row for each anchor and a column for each of its
    groups, and bound the scores that count; a group with ``low > high`` is empty.
    """
    slots = low.shape[1]
    floor = low.copy()
    group, place, score = (np.zeros(0, np.int64) for _ in range(3))
    live = low <= high
    top = np.where(live, high, np.iinfo(np.int64).min).max(1).astype(float)
    strip = max(1, STRIP_PAIRS // max(len(a.row), 1))
    for start in range(0, len(b.row), strip):
        part = b.take(slice(start, start + strip))
        bottom = np.where(live, floor, np.iinfo(np.int64).max).min(1).astype(float)
        i, j, s = possible(length, a, part, same, bottom, top)
        more = []
        for slot in range(slots):
            ok = live[i, slot] & (s >= floor[i, slot]) & (s <= high[i, slot])
            more.append((i[ok] * slots + slot, j[ok] + start, s[ok]))
        group, place, score = (
            np.concatenate([old, *(m[n] for m in more)])
            for n, old in enumerate((group, place, score)))
        order = np.lexsort((b.row[place], b.ids[place], -score, group))
        group, place, score = group[order], place[order], score[order]
        first = np.searchsorted(group, group)
        rank = np.arange(len(group)) - first
        # a full group's last score is the least that still counts
        last = rank == k - 1
        floor.reshape(-1)[group[last]] = score[last]
        kept = rank < k
        group, place, score = group[kept], place[kept], score[kept]
    return group, place, score


def share_from(score: np.ndarray, least: int, whole: int) -> np.ndarray:
    """The least whole number ``n`` with ``least * score <= whole * n``."""
    return score // whole * least - (-(score % whole) * least) // whole


def join_tiles(same: bool, k: int, least: int, whole: int):
    """A function of two tiles, rows and anchors, that gives ``FOUND`` rows."""
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("partner", pa.int64()),
                        ("id", pa.int64()), ("score", pa.int64())])

    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        others = {length: side for length, _, side in sides(rows)}
        scores = anchors["scores"].combine_chunks()
        out = [schema.empty_table()]
        for length, at, side in sides(anchors):
            if length not in others:
                continue
            b, limit = others[length], np.iinfo(np.int64).max
            if same:
                low, high = np.full((len(at), 1), -limit), np.full((len(at), 1), limit)
            else:
                own = scores.take(pa.array(at)).to_pylist()
                slots = max(map(len, own), default=0)
                # groups that are not there have bounds no score can meet
                high = np.full((len(at), max(slots, 1)), -limit)
                low = np.full_like(high, limit)
                for i, found in enumerate(own):
                    high[i, :len(found)] = found
                    low[i, :len(found)] = share_from(np.array(found, np.int64), least, whole)
            group, place, score = best_rows(length, side, b, same, low, high, k)
            slots = low.shape[1]
            out.append(pa.table([
                side.row[group // slots], (group % slots).astype(np.int32), b.row[place],
                pa.array(b.ids[place], mask=~b.known[place]), score], schema=schema))
        return pa.concat_tables(out)

    return join


# --- jobs -------------------------------------------------------------------

def prepared_rows(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """``row, id, label, vector, means, deviations`` of the rows that take part."""
    own = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.arrow_udf(prepare, PREPARED)(F.col(vector)).alias("p"))
    return materialise(own.where("p is not null").select("row", "id", "label", "p.*"))


def tiles_of(df: DataFrame, tile_bytes: int) -> int:
    size = df.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    return max(1, -(-size // tile_bytes))


def best_of_all(rows: DataFrame, anchors: DataFrame, same: bool, k: int,
                least: int = LEAST, whole: int = WHOLE) -> DataFrame:
    """``FOUND`` and ``rank``: the ``k`` best rows of every anchor and slot."""
    across, down = tiles_of(anchors, ANCHOR_TILE_BYTES), tiles_of(rows, ROW_TILE_BYTES)

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    def own(number: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(number)).cast("int")

    keys = ["anchor_tile", "row_tile"]
    left = rows.select(every(across).alias(keys[0]), own(down).alias(keys[1]), *rows.columns)
    # named anew: both sides come from one table
    right = anchors.select(own(across).alias(keys[0]), every(down).alias(keys[1]),
                           *(F.col(c).alias(c) for c in anchors.columns))
    joined = join_tiles(same, k, least, whole)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: joined(a, b), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(
        F.desc("score"), F.asc_nulls_last("id"), "partner")
    return materialise(found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k))


def mine(df: DataFrame, is_anchor: Callable[[Column], Column], vec_id: str = "vec_id",
         label: str = "label", vector: str = "embedding", positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST, whole: int = WHOLE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` tells anchors by their ids; null ids are no anchors. For each
    anchor and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels with
    ``least * positive_score <= whole * negative_score <= whole * positive_score``.

    Rows with a null label or vector, or a null or not finite component, take no
    part; neither do vectors so long that scores pass a long (a squared length of
    2^62 after scaling). Vectors of different lengths never meet, and those without
    components score 0. Each row counts by itself, also where an id repeats, but a
    row is never its own id's partner. Ties beyond the id, and null ids, which come
    last, go by an arbitrary but fixed row number. Other columns take no part.
    """
    rows = prepared_rows(df, vec_id, label, vector)
    anchors = rows.where(F.col("id").isNotNull() & is_anchor(F.col("id")))
    found = best_of_all(rows, anchors.withColumn("scores", F.array().cast("array<bigint>")),
                        True, positives)
    own = found.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("rank", "id", "score"))).alias("own"))
    chosen = anchors.join(own, F.col("row") == F.col("anchor")).select(
        *anchors.columns, F.transform("own", lambda p: p["score"]).alias("scores"))
    hard = best_of_all(rows, chosen, False, negatives, least, whole)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.select(
        "anchor", "slot", "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score")
    ).join(own, "anchor").join(names, "anchor").select(
        "anchor_id", F.get("own", F.col("slot"))["id"].alias("positive_id"), "rank",
        "negative_id", F.get("own", F.col("slot"))["score"].alias("positive_score"),
        "negative_score")
