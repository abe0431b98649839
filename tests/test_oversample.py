"""Exact neighbours against all distances, and the rows made from them."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from classweave.operators import neighbours, oversample, sampling


def points(spark, values):
    return spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(values)],
        "id long, x array<double>").repartition(3)


def plain(values, k):
    """(distance, id) of the nearest others, ties by id."""
    gaps = neighbours.squared(values, values)
    np.fill_diagonal(gaps, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(values)), gaps.shape), gaps))
    return [[(gaps[i, j], int(j)) for j in row[:k] if j != i] for i, row in enumerate(order)]


def check(spark, values, k, **options):
    found = neighbours.nearest(points(spark, values), values.shape[1], k, **options)
    rows = {r["id"]: r for r in found.collect()}
    want = plain(values, k)
    assert len(rows) == len(values)
    for i, row in rows.items():
        assert [(n["distance"], n["id"]) for n in row["near"]] == want[i], i
        assert row["x"] == values[i].tolist()
        assert all(n["x"] == values[n["id"]].tolist() for n in row["near"])


@pytest.mark.parametrize("cell_rows", [40, 10_000])
def test_neighbours_are_exact(spark, cell_rows):
    draw = np.random.default_rng(1)
    check(spark, np.concatenate([draw.normal(size=(700, 3)), draw.normal(5, 0.1, (100, 3))]),
          5, cell_rows=cell_rows)


def test_ties_copies_and_crowds(spark, monkeypatch):
    """A grid of equal distances, a third of all points in one place, groups in parts."""
    draw = np.random.default_rng(2)
    grid = draw.integers(0, 6, (300, 2)).astype(float)
    values = np.concatenate([grid, np.full((200, 2), 2.0), [[-0.0, 0.0], [0.0, -0.0]]])
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 10)
    check(spark, values, 4, cell_rows=5)


def test_many_axes_and_small_cells(spark):
    """Balls that reach many cells take several rounds."""
    check(spark, np.random.default_rng(3).uniform(size=(400, 8)), 3, cell_rows=4)


@pytest.mark.parametrize("rows", [1, 2, 4])
def test_fewer_points_than_neighbours(spark, rows):
    check(spark, np.arange(rows * 2, dtype=float).reshape(rows, 2), 5, cell_rows=1)


def test_no_points(spark):
    empty = points(spark, np.zeros((1, 2))).filter("id < 0")
    assert neighbours.nearest(empty, 2, 5).count() == 0


def test_trees_lose_no_box():
    draw = np.random.default_rng(4)
    values = draw.normal(size=(500, 3))
    tree = neighbours.grow(values[:200], 16)
    cells = tree.cells(values)
    assert tree.leaves == 16 and len(set(cells.tolist())) == 16
    reach = np.full(50, 0.3)
    met = {(i, c) for rows, c, far in tree.within(values[:50], reach) for i in rows.tolist()}
    gaps = neighbours.squared(values[:50], values)
    assert {(i, int(cells[j])) for i, j in zip(*np.nonzero(gaps <= 0.3))} <= met
    for i in range(10):
        order = tree.nearest(values[i], 16)
        assert sorted(order) == list(range(16)) and order[0] == cells[i]


def labelled(spark, values, minority):
    rows = [(i, [float(v) for v in row], float(i < minority)) for i, row in enumerate(values)]
    df = spark.createDataFrame(rows, "key long, x array<double>, label double")
    return df.select("key", array_to_vector("x").alias("features"), "label")


def test_synthetic_rows_fill_the_gap(spark):
    values = np.random.default_rng(3).uniform(0, 1, (480, 2))
    df = labelled(spark, values, 80)
    balance = sampling.measure_balance(df)
    made = oversample.synthetic_minority(df, balance, "key", size=2)
    found = made.select("parent", vector_to_array("features").alias("x"), "label").collect()
    assert len(found) == 320  # 400 - 80: a whole number of copies each
    assert {r["label"] for r in found} == {1.0}
    assert {r["parent"] for r in found} == set(range(80))
    near = plain(values[:80], 5)
    for r in found:  # on the line from the parent to one of its neighbours
        start, x = values[r["parent"]], np.array(r["x"])
        arms = np.array([values[j] for _, j in near[r["parent"]]]) - start
        step = x - start
        cross = np.abs(arms[:, 0] * step[1] - arms[:, 1] * step[0])
        along = (arms @ step >= -1e-9) & ((arms ** 2).sum(1) >= (step ** 2).sum() - 1e-9)
        assert (cross[along] < 1e-9).any()
    again = oversample.synthetic_minority(df.repartition(5), balance, "key", size=2, cell_rows=9)
    assert made.exceptAll(again).count() == 0


def test_a_lone_row_is_copied(spark):
    df = labelled(spark, np.arange(100, dtype=float).reshape(50, 2), 1)
    made = oversample.synthetic_minority(df, sampling.measure_balance(df), "key", size=2)
    rows = made.select("parent", vector_to_array("features").alias("x")).collect()
    assert len(rows) == 48 and all(r["x"] == [0.0, 1.0] and r["parent"] == 0 for r in rows)


def test_the_first_cell_holds_the_point_on_cuts_too():
    values = np.random.default_rng(5).integers(0, 6, (500, 3)).astype(float)
    tree = neighbours.grow(values, 32)
    assert tree.cells(values).tolist() == [tree.nearest(v, 1)[0] for v in values]
    # and it is the first of those that the later visits skip
    found = list(tree.within(values, np.full(len(values), 0.5)))
    home = np.full(len(values), 10**6)
    for rows, cell, far in found:
        at = rows[far == 0]
        home[at] = np.minimum(home[at], cell)
    assert home.tolist() == tree.cells(values).tolist()


def test_a_point_meets_few_points_of_its_cell(spark):
    """The work per point is a cell's size, at the size used without options."""
    values = np.random.default_rng(6).uniform(size=(9000, 2))
    locs = neighbours.locations(points(spark, values), 2)
    tree = neighbours.plant(locs, 2)
    assert np.bincount(tree.cells(values)).max() <= 2 * 2_000
    check(spark, values[:5000], 3)
