"""Collision counting against all cosines: counts, components, recall."""

import math

import numpy as np
import pytest

from brute import reach
from classweave.llm import embedding_dedup as e
from classweave.llm import queries
from compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, copies string"


def planted(n, length, seed):
    """Centres with members at cosines on both sides of the threshold."""
    draw = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = draw.standard_normal(length)
        for _ in range(draw.integers(1, 9)):
            noise = draw.standard_normal(length) * draw.choice([0.02, 0.1, 0.25, 0.4])
            rows.append((centre + noise).astype(np.float32))
    return rows[:n]


def cosines(vectors):
    v = np.array(vectors, np.float64)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    return v @ v.T


def check(spark, rows):
    found = e.links(spark.createDataFrame(rows, SCHEMA)).collect()
    at = {r[0]: i for i, r in enumerate(rows)}
    near = cosines([r[1] for r in rows]) >= e.THRESHOLD
    same = np.array([[a[2] == b[2] for a in rows] for b in rows])
    near &= same
    expected = reach(sorted(at), lambda a, b: near[at[a], at[b]])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        i: (int(near[at[i]].sum()) - 1, expected[i], expected[i] == i) for i in at}
    assert len(found) == len(rows)


@pytest.mark.parametrize("length,tile", [(64, 2_000_000), (64, 30_000), (3, 2_000), (1, 400)])
def test_equals_all_cosines(spark, monkeypatch, length, tile):
    monkeypatch.setattr(e, "TILE_BYTES", tile)
    vectors = planted(260, length, length)
    rows = [(i * 7 % 1000, v.tolist(), i % 3, "x") for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "y") for i in range(0, 60, 2)]
    check(spark, rows)


def test_recall_at_the_threshold():
    """Pairs at the threshold itself, in more dimensions than projections."""
    draw = np.random.default_rng(2)
    n, length = 3000, 96
    a = draw.standard_normal((n, length))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.standard_normal((n, length))
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = e.THRESHOLD + 1e-9
    b = cosine * a + math.sqrt(1 - cosine ** 2) * b
    vectors = np.concatenate([a, b])
    linked, least = e.compare_tiles(
        np.arange(2 * n), np.ones(2 * n, np.int64), np.zeros(2 * n, np.int64),
        vectors, e.THRESHOLD)
    assert (linked >= 1).mean() >= 0.9999
    assert (least[n:] == np.arange(n)).mean() >= 0.9999


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(e, "TILE_BYTES", 100_000)
    draw = np.random.default_rng(4)
    centre = draw.standard_normal(64)
    rows = [(i, (centre + 0.02 * draw.standard_normal(64)).tolist(), 1, "x")
            for i in range(600)]
    found = e.links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(599, 0)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0], 1, "a"), (4, [2.0, 4.0], 1, "b"), (4, [2.0, 4.0], 1, "b"),
        (3, [1.0, 2.0], 2, "c"), (2, [1.0, 2.0, 0.0], 1, "d"), (1, [1.0, 2.0], None, "e"),
        (6, None, 1, "f"), (7, [0.0, 0.0], 1, "g"), (8, [nan, 1.0], 1, "h"),
        (9, [inf, 1.0], 1, "i"), (10, [None, 1.0], 1, "j"), (11, [], 1, "k"),
        (None, [1.0, 2.0], 2, "l"), (None, [0.0, 1.0], 3, "m"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept)
                    for r in e.links(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 6, 7, 8, 9, 10, 11)]
    assert found == sorted(alone + [
        (5, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (3, 1, 3, True),
        (None, 1, 3, False), (None, 0, None, True)], key=str)
    assert e.links(frame.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(queries.QUERIES["op4_embedding_dedup"](spark, folder), connect(folder),
                   queries.ORACLES["op4_embedding_dedup"]) is None
