"""Exact nearest neighbours of all points among themselves, cell by cell.

Points are dealt to the cells of a k-d tree whose cuts halve a bounded sample; the
cuts steer the work, never the result. Every point first meets the points of its
own cell. The distance of the last neighbour found is a radius: only cells that
come nearer than that can hold a nearer one. A point that such cells are left for
is copied to the nearest of them, its radius shrinks, and so on until no cell is
left for any point.

Coinciding points are one location with a count, and of their ids only as many as
an answer can name, so that no number of copies makes a cell large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classweave.functions.joins import lookup
from classweave.session import materialise

# every point meets all points of a cell, so the work grows with this number
CELL_ROWS = 2_000
# the tree goes to every task; beyond this many cells, cells grow
MAX_CELLS = 4096
SAMPLE_PER_CELL = 32
# copies of a point in each round after its own cell, then the last of these
VISITS = (8, 64)
# points that meet a cell's points in one group
GROUP_ROWS = 50_000
# pairs whose distances are held at once
PAIRS = 2_000_000
# points whose cells are listed at once, each at most all cells
TOGETHER = 256
# boxes are compared with a radius by this much less, so rounding loses nothing
SLACK = 1e-9

FOUND = "array<struct<distance:double,id:bigint,x:array<double>>>"


# --- the tree ---------------------------------------------------------------

@dataclass(frozen=True)
class Tree:
    """A full binary tree in an array: node ``i`` has ``2 i + 1`` and ``2 i + 2``.

    A point goes right if its coordinate ``axis`` is above ``cut``. A node that
    was not worth cutting sends all points left.
    """

    axis: np.ndarray
    cut: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.axis) + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.leaves.bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def within(self, x: np.ndarray, radius: np.ndarray) -> Iterator[tuple]:
        """(points, cell, squared distance of its box) for boxes within radius."""
        stack = [(0, np.arange(len(x)), np.zeros_like(x), np.zeros(len(x)))]
        while stack:
            node, rows, gap, far = stack.pop()
            if node >= len(self.axis):
                yield rows, node - len(self.axis), far
                continue
            axis, cut = self.axis[node], self.cut[node]
            off = x[rows, axis] - cut
            for child, out in ((2 * node + 1, np.maximum(off, 0)),
                               (2 * node + 2, np.maximum(-off, 0))):
                more = np.maximum(out, gap[:, axis])
                reach = far - gap[:, axis] ** 2 + more ** 2
                kept = reach <= radius[rows]
                if kept.any():
                    own = gap[kept].copy()
                    own[:, axis] = more[kept]
                    stack.append((child, rows[kept], own, reach[kept]))

    def nearest(self, x: np.ndarray, count: int) -> list[int]:
        """The nearest cells of one point, for one that has no radius yet."""
        heap, found = [(0.0, 0, tuple([0.0] * len(x)))], []
        while heap and len(found) < count:
            far, node, gap = heapq.heappop(heap)
            if node >= len(self.axis):
                found.append(node - len(self.axis))
                continue
            axis, cut = int(self.axis[node]), self.cut[node]
            if not np.isfinite(cut):
                heapq.heappush(heap, (far, 2 * node + 1, gap))
                continue
            for child, out in ((2 * node + 1, max(x[axis] - cut, 0.0)),
                               (2 * node + 2, max(cut - x[axis], 0.0))):
                more = max(out, gap[axis])
                heapq.heappush(heap, (far - gap[axis] ** 2 + more ** 2, child,
                                      (*gap[:axis], more, *gap[axis + 1:])))
        return found


def grow(sample: np.ndarray, cells: int) -> Tree:
    """Cuts at the medians of the widest axis; ``cells`` is a power of two."""
    axis, cut = np.zeros(cells - 1, np.int64), np.full(cells - 1, np.inf)
    parts = {0: sample}
    for node in range(cells - 1):
        own = parts.pop(node)
        left, right = own, own[:0]
        if len(own) > 1:
            spread = own.max(0) - own.min(0)
            axis[node] = int(spread.argmax())
            values = own[:, axis[node]]
            middle = np.median(values)
            if middle == values.max():  # more than half stand at the top
                middle = values[values < middle].max(initial=-np.inf)
            if spread.max() > 0 and np.isfinite(middle):
                cut[node] = middle
                right_side = values > middle
                left, right = own[~right_side], own[right_side]
        parts[2 * node + 1], parts[2 * node + 2] = left, right
    return Tree(axis, cut)


# --- what a task does -------------------------------------------------------

def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed axis by axis in order."""
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        gap = a[:, axis, None] - b[None, :, axis]
        total += gap * gap
    return total


def nearest_in(points: np.ndarray, ids: np.ndarray, x: np.ndarray, radius: np.ndarray,
               count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, squared distance) of each query's best points within its radius."""
    strip = max(1, PAIRS // max(len(points), 1))
    for start in range(0, len(x), strip):
        far = squared(x[start:start + strip], points)
        limit = radius[start:start + strip, None]
        if len(points) > count:
            limit = np.minimum(limit, np.partition(far, count - 1, axis=1)[:, count - 1:count])
        i, j = np.nonzero(far <= limit)
        order = np.lexsort((ids[j], far[i, j], i))
        i, j = i[order], j[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < count
        i, j = i[kept], j[kept]
        yield i + start, j, far[i, j]


def _visit(size: int, count: int):
    schema = pa.schema([("loc", pa.int64()), ("distance", pa.float64()),
                        ("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def visit(cell: pa.Table, visits: pa.Table) -> pa.Table:
        if not len(cell) or not len(visits):
            return schema.empty_table()
        ids = cell["ids"].combine_chunks()
        points = np.repeat(_matrix(cell["x"], size), ids.value_lengths().to_numpy(), axis=0)
        ids = ids.flatten().to_numpy()
        loc = visits["loc"].to_numpy()
        out = [schema.empty_table()]
        for i, j, far in nearest_in(points, ids, _matrix(visits["x"], size),
                                    visits["radius"].to_numpy(), count):
            ends = np.arange(0, (len(j) + 1) * size, size, dtype=np.int32)
            x = pa.ListArray.from_arrays(ends, points[j].reshape(-1))
            out.append(pa.table([loc[i], far, ids[j], x], schema=schema))
        return pa.concat_tables(out)

    return visit


def _next_cells(tree, size: int):
    """For each point: the cells to visit next, and how many it will have seen."""
    def cells(x: pa.Array, radius: pa.Array, seen: pa.Array, limit: pa.Array) -> pa.Array:
        own = tree.value
        points = _matrix(pa.chunked_array([x]), size)
        reach = radius.to_numpy() * (1 + SLACK)
        skip, most = seen.to_numpy(), limit.to_numpy()
        out: list = [None] * len(points)
        home = own.cells(points)
        near = np.flatnonzero(np.isfinite(reach))
        # points of one place are listed together, so that each list meets few boxes
        near = near[np.argsort(home[near], kind="stable")]
        for start in range(0, len(near), TOGETHER):
            known = np.sort(near[start:start + TOGETHER])
            found = list(own.within(points[known], reach[known]))
            row = np.concatenate([r for r, _, _ in found])
            cell = np.concatenate([np.full(len(r), c) for r, c, _ in found])
            order = np.lexsort((cell, np.concatenate([f for _, _, f in found]), row))
            row, cell = row[order], cell[order]
            place, at = np.arange(len(row)) - np.searchsorted(row, row), known[row]
            kept = (place >= skip[at]) & (place < skip[at] + most[at])
            at, cell = at[kept], cell[kept]
            first, last = np.searchsorted(at, known), np.searchsorted(at, known, "right")
            for n, low, high in zip(known.tolist(), first, last):
                out[n] = cell[low:high].tolist()
        # the first cell to visit is the one that holds the point
        fresh = ~np.isfinite(reach) & (skip == 0) & (most == 1)
        for n in np.flatnonzero(fresh):
            out[n] = [int(home[n])]
        for n in np.flatnonzero(~np.isfinite(reach) & ~fresh):
            out[n] = own.nearest(points[n], int(skip[n] + most[n]))[skip[n]:]
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(cells, "array<bigint>")


# --- jobs -------------------------------------------------------------------

def locations(points: DataFrame, count: int) -> DataFrame:
    """``loc, x, ids, n``: coinciding points as one, named by its smallest id."""
    order = Window.partitionBy("x").orderBy("id")
    first = points.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= count)
    ids = first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = points.groupBy("x").agg(F.count("*").alias("n"))
    return materialise(ids.join(sizes, "x").select(
        F.col("ids")[0].alias("loc"), "x", "ids", "n"))


def plant(locs: DataFrame, size: int, cell_rows: int = CELL_ROWS) -> Tree:
    """A tree for the locations, from a sample by hash that does not grow with them."""
    wanted = min(-(-locs.count() // cell_rows), MAX_CELLS)
    cells = 1 << max(wanted - 1, 0).bit_length()
    # at most MAX_CELLS x SAMPLE_PER_CELL points
    rows = locs.select("x", F.xxhash64("loc").alias("h")).orderBy("h", "x").limit(
        cells * SAMPLE_PER_CELL).select("x").collect() if cells > 1 else []
    return grow(np.array([r["x"] for r in rows], float).reshape(-1, size), cells)


def nearest(points: DataFrame, size: int, neighbours: int,
            cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, x, near): the nearest other points of every point, nearest first.

    ``points`` holds unique (id, x), ``x`` an array of ``size`` finite numbers.
    ``near`` lists structs (distance, id, x), the distance squared, ties by id,
    shorter only where there are fewer other points. Exact at any size.
    """
    spark = points.sparkSession
    count = neighbours + 1  # a location finds itself
    # one zero, so that equal points are written alike
    points = materialise(points.select(
        F.col("id").cast("long").alias("id"), F.transform("x", lambda v: v + 0.0).alias("x")))
    locs = locations(points, count)
    planted = plant(locs, size, cell_rows)
    tree = spark.sparkContext.broadcast(planted)
    next_cells = _next_cells(tree, size)
    cell_of = F.arrow_udf(lambda x: pa.array(
        tree.value.cells(_matrix(pa.chunked_array([x]), size))), "bigint")
    cells = materialise(locs.withColumn("cell", cell_of("x")))
    # the first visit goes to the nearest cell, which holds the point
    state = locs.select(
        "loc", "x", F.array().cast(FOUND).alias("found"), F.lit(0).alias("seen"),
        F.lit(float("inf")).alias("radius"))
    done, step = [], 0
    while True:
        limit = 1 if step == 0 else VISITS[min(step, len(VISITS)) - 1]
        state = materialise(state.withColumn(
            "next", next_cells("x", "radius", "seen", F.lit(limit))))
        done.append(state.filter(F.size("next") == 0).select("loc", "found"))
        going = state.filter(F.size("next") > 0)
        visits = going.select("loc", "x", "radius", F.explode("next").alias("cell"))
        # a row per cell
        parts = materialise(visits.groupBy("cell").agg(
            F.ceil(F.count("*") / GROUP_ROWS).alias("parts")))
        if parts.isEmpty():
            break
        found = materialise(_meet(cells, visits, parts, size, count))
        new = found.groupBy("loc").agg(F.collect_list(F.struct("distance", "id", "x")).alias("new"))
        best = F.slice(F.array_sort(F.concat("found", F.coalesce(
            "new", F.array().cast(FOUND)))), 1, count)
        state = going.join(new, "loc", "left").select(
            "loc", "x", best.alias("found"), (F.col("seen") + F.size("next")).alias("seen")
        ).withColumn("radius", F.when(
            F.size("found") == count, F.element_at("found", -1)["distance"]
        ).otherwise(float("inf")))
        step += 1
    answers = done[0]
    for part in done[1:]:
        answers = answers.unionByName(part)
    by_place = locs.select("loc", F.to_json("x").alias("key"), "n").join(answers, "loc").drop("loc")
    joined = lookup(points, F.to_json("x"), by_place, "n", points.count())
    others = F.filter("found", lambda f: f["id"] != F.col("id"))
    return joined.select("id", "x", F.slice(others, 1, neighbours).alias("near"))


def _meet(cells: DataFrame, visits: DataFrame, parts: DataFrame,
          size: int, count: int) -> DataFrame:
    """Visits and the points of their cells; a crowd of visitors comes in parts."""
    own = cells.join(F.broadcast(parts), "cell").select(
        "cell", "x", "ids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    come = visits.join(F.broadcast(parts), "cell").withColumn(
        "part", F.pmod(F.xxhash64("loc"), "parts"))
    visit = _visit(size, count)
    return own.groupBy("cell", "part").cogroup(come.groupBy("cell", "part")).applyInArrow(
        lambda a, b: visit(a, b), "loc bigint, distance double, id bigint, x array<double>")
