"""Hard negatives against all scores, and the bounds that spare them."""

import math

import numpy as np
import pytest

from classweave.llm import hard_negatives, queries
from compare import compare, connect

TYPE = "vec_id long, label int, embedding array<double>, id string, score int"


def plain(rows, is_anchor, positives=5, negatives=5, least=80, whole=100):
    """Scores in Python's whole numbers; rows that tie beyond their id are left out."""
    kept = []
    for i, y, v, *_ in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole_v = [math.floor(x * 256) for x in v]
        if sum(x * x for x in whole_v) < 2 ** 62:
            kept.append((i, y, whole_v))
    out = []
    for i, y, v in kept:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j is None, j or 0, z == y)
                        for j, z, w in kept if len(w) == len(v) and j != i)
        mine = [(-s, None if none else j) for s, none, j, same in scored if same][:positives]
        for p, j in mine:
            hard = [(-s, None if none else n) for s, none, n, same in scored
                    if not same and least * p <= -whole * s <= whole * p][:negatives]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(docs, is_anchor=lambda i: i % 10 == 0, **options):
    found = hard_negatives.mine(docs, is_anchor, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id",
                             "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


def clustered(n, length, seed=0):
    """Rows near a few centres, so that bounds and ranks have work to do."""
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((4, length)) + 1
    return [(i, int(draw.integers(3)),
             (centres[draw.integers(4)] + draw.standard_normal(length) * 0.5).tolist(), "x", 1)
            for i in range(n)]


ODD = [
    (None, 1, [1.0] * 16, "x", 1), (None, None, [1.0] * 16, "x", 1), (5000, 1, None, "x", 1),
    (5010, None, [1.0] * 16, "x", 1), (5020, 1, [float("nan")] * 16, "x", 1),
    (5030, 1, [None] * 16, "x", 1), (5040, 1, [], "x", 1), (5041, 1, [], "x", 1),
    (5042, 2, [], "x", 1), (5050, 2, [0.0] * 16, "x", 1), (5051, 2, [0.0] * 16, "x", 1),
    (5060, 0, [1.5, 2.0, -7.25], "x", 1), (5061, 0, [1.0, 2.0, -7.0], "x", 1),
    (5062, 1, [1.0, 2.0, -6.5], "x", 1), (5070, 1, [float("inf")] * 16, "x", 1),
    (5080, 1, [1e300] * 16, "x", 1), (-10, 1, [2.0] * 16, "x", 1),
]
HUGE = [(7000 + i, i % 2, [1e6 + i, 2e6 - i * 3.5, 1e5 * i], "x", 1) for i in range(30)]


@pytest.mark.parametrize("options", [{}, {"positives": 2, "negatives": 9, "least": 7, "whole": 9}])
def test_equals_all_scores(spark, options):
    rows = clustered(700, 16) + ODD + HUGE
    docs = spark.createDataFrame(rows, TYPE)
    expected = plain(rows, lambda i: i % 10 == 0, **options)
    assert len(expected) > 300
    assert mined(docs, **options) == expected
    assert mined(docs.where("vec_id < -100")) == []


def test_tiles_and_strips_change_nothing(spark, monkeypatch):
    rows = clustered(500, 20, seed=4) + ODD
    expected = plain(rows, lambda i: i % 10 == 0)
    monkeypatch.setattr(hard_negatives, "ROW_TILE_BYTES", 20_000)
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE_BYTES", 3_000)
    assert mined(spark.createDataFrame(rows, TYPE)) == expected


def test_repeated_rows(spark):
    """Copies count one by one, but never as partners of their own id."""
    rows = [(10, 0, [1.0, 1.0], "x", 1)] * 2 + [(11, 0, [1.0, 1.0], "x", 1)] * 3 + [
        (12, 1, [1.0, 1.0], "x", 1)] * 2 + [(13, 1, [1.0, 0.7], "x", 1)]
    docs = spark.createDataFrame(rows, TYPE)
    assert mined(docs) == plain(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_refine():
    draw = np.random.default_rng(2)
    for length in (1, 3, 16, 37):
        x = np.floor(draw.standard_normal((60, length)) * 256)
        width_before = None
        for level in hard_negatives.LEVELS:
            means, rest = hard_negatives.summary(x, level)
            middle = (means * hard_negatives.widths(length, level)) @ means.T
            half = rest @ rest.T
            assert (np.abs(x @ x.T - middle) <= half + 1e-6).all()
            assert width_before is None or half.sum() <= width_before + 1e-6
            width_before = half.sum()


def test_strips_equal_all_pairs(monkeypatch):
    """The floor that rises from strip to strip loses nothing."""
    draw = np.random.default_rng(8)
    x = draw.integers(-4, 5, (300, 6)).astype(float)
    n = np.arange(len(x))
    levels = [hard_negatives.summary(x, level) for level in hard_negatives.LEVELS]
    side = hard_negatives.Side(n, n // 2, n % 5 > 0, n % 3, x, levels)
    few = side.take(slice(0, 20))
    low, high = draw.integers(-30, 30, (2, 20, 4))
    expected = []
    for i in range(20):
        for slot in range(4):
            scored = [(-int(x[i] @ x[j]), n[j] // 2, j) for j in range(len(x))
                      if few.label[i] != side.label[j]
                      and not (side.known[j] and few.ids[i] == side.ids[j])
                      and low[i, slot] <= x[i] @ x[j] <= high[i, slot]]
            expected += [(i * 4 + slot, j, -s) for s, _, j in sorted(scored)[:3]]
    for pairs in (40, 500, 10**6):
        monkeypatch.setattr(hard_negatives, "STRIP_PAIRS", pairs)
        found = hard_negatives.best_rows(6, few, side, False, low, high, 3)
        assert list(zip(*(part.tolist() for part in found))) == expected


def test_bounds_spare_scores():
    """Of rows with different means, few are scored."""
    draw = np.random.default_rng(3)
    centre = np.repeat(draw.choice([-1, 1], (2000, 4)), 8, axis=1) * 256
    x = np.floor(centre + draw.standard_normal((2000, 32)) * 20)
    levels = [hard_negatives.summary(x, level) for level in hard_negatives.LEVELS]
    n = np.arange(len(x))
    side = hard_negatives.Side(n, n, n >= 0, n % 2, x, levels)
    few = side.take(slice(0, 50))
    low = np.full(50, 28 * 256.0 * 256)
    i, j, s = hard_negatives.possible(32, few, side, True, low, np.full(50, np.inf))
    every = few.vectors @ x.T
    same = (few.label[:, None] == side.label) & (few.ids[:, None] != side.ids)
    assert set(zip(*np.nonzero((every >= low[:, None]) & same))) <= set(zip(i, j))
    assert len(i) < 0.1 * every.size and (s == every[i, j]).all()


def test_query_equals_sql(spark):
    for size in ("0.001", "0.01", "0.1"):
        sf = f"/root/testdata/sf{size}"
        assert compare(queries.QUERIES["op12_hard_negatives"](spark, sf), connect(sf),
                       queries.ORACLES["op12_hard_negatives"]) is None
