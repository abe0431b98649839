"""Every query that SQL can express, against DuckDB on the same tables."""

import re

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect

ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()
UNPAIRED = sorted(set(QUERIES) - set(ORACLES))
# the corpus operators have tests of their own beside them
OWN_TESTS = re.compile(r"op\d+_|pipeline$").match
SLOW = {"best_model", "cv_grid", "cv_best_model", "model_compare", "tune_models",
        "tune_boosting", "tune_forest"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if n not in SLOW and not OWN_TESTS(n)])
def test_matches_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in UNPAIRED if n not in SLOW and not OWN_TESTS(n)])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 50
