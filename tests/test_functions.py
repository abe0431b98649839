import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classweave import session
from classweave.functions import chi, hashing, quantiles, running

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def disc(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 9))) - 1]


@pytest.mark.parametrize("shape", ["even", "skewed", "hot", "two", "constant"])
def test_exact_quantiles_by_narrowing(spark, shape):
    """Forced through many rounds, also where one value fills a third."""
    rng = np.random.default_rng(5)
    data = {
        "even": rng.uniform(-5, 5, 6000),
        "skewed": rng.lognormal(0, 4, 6000),
        "hot": np.concatenate([rng.normal(0, 1, 4000), np.full(2000, 0.25)]),
        "two": np.concatenate([np.full(3000, 1.0), np.full(3000, 2.0)]),
        "constant": np.full(6000, 3.5),
    }[shape].tolist()
    df = spark.createDataFrame([(v,) for v in data], "v double")
    found = quantiles.exact_quantiles(
        df, ["v"], PROBS, finish_rows=20, accuracy=50)["v"]
    assert found == [disc(data, p) for p in PROBS]


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)],
        "v double, w double")
    assert quantiles.quantiles(df, ["v", "w"], [0.5, 1.0], 0) == {
        "v": [1.0, 3.0], "w": None}
    assert quantiles.quantiles(df, ["v", "w"], [1.0], 0.01) == {
        "v": [3.0], "w": None}


def test_columns_found_without_case(spark):
    df = spark.createDataFrame([(1,), (5,)], "Age int")
    assert quantiles.quantiles(df, ["age"], [1.0], 0) == {"age": [5.0]}


@pytest.mark.parametrize("window_rows", [10, 97, 10_000])
def test_running_totals(spark, window_rows):
    df = session.materialise(spark.range(500).select(
        (F.col("id") * 7 % 500).cast("double").alias("score"),
        (F.col("id") % 3).alias("n")))
    rows = {r["score"]: r for r in running.running_totals(
        df, "score", ["n"], window_rows).collect()}
    total = 0
    for score in sorted(rows):
        total += rows[score]["n"]
        assert rows[score]["n_upto"] == total
    assert len(rows) == 500


@pytest.mark.parametrize("window_rows", [7, 40, 10_000])
def test_running_totals_by_segment(spark, window_rows):
    """One segment of most rows, many of few, and not-a-number last."""
    df = session.materialise(spark.range(600).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 60).cast("int").alias("model"),
        F.lit(3).alias("fold"),
        F.when(F.col("id") == 5, float("nan")).otherwise(
            F.col("id") * 7 % 600).cast("double").alias("score"),
        (F.col("id") % 5).alias("n"), (F.col("id") % 2).alias("m")))
    rows = running.running_totals(
        df, "score", ["n", "m"], window_rows, ["model", "fold"]).collect()
    assert len(rows) == 600
    totals = {}
    for r in sorted(rows, key=lambda r: (r["model"], r["score"] != r["score"], r["score"])):
        n, m = totals.get(r["model"], (0, 0))
        totals[r["model"]] = n, m = n + r["n"], m + r["m"]
        assert (r["n_upto"], r["m_upto"]) == (n, m)


def test_global_rank(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("a"), (F.col("id") * 17 % 3000).alias("b"))
    rows = running.global_rank(df.repartition(6), [F.desc("a"), "b"]).collect()
    assert len(rows) == 3000
    in_order = sorted(rows, key=lambda r: (-r["a"], r["b"]))
    assert [r["rank"] for r in in_order] == list(range(3000))


def test_hash_is_the_same_under_any_partitioning(spark):
    base = spark.range(4000).withColumnRenamed("id", "key")
    kept = [
        {r["key"] for r in base.repartition(n).filter(
            hashing.hash_below(["key"], 42, 0.3)).collect()}
        for n in (1, 3, 8)
    ]
    assert kept[0] == kept[1] == kept[2]
    assert 1080 < len(kept[0]) < 1320


def test_hex_order_is_number_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "key")
    wrong = df.filter(
        hashing.hash_below(["key"], 1, 0.37)
        != (hashing.hash_number(["key"], 1) < 0.37 * hashing.HASH_SPACE))
    assert wrong.count() == 0
    assert df.filter(hashing.hash_below(["key"], 1, 1.0)).count() == 3000
    assert df.filter(hashing.hash_below(["key"], 1, 0.0)).count() == 0
    with pytest.raises(ValueError):
        hashing.hash_below(["key"], 1, 1.5)


def test_chi_square_tail():
    # table values: the 5 % and 1 % points of the distribution
    for dof, five, one in [(1, 3.841459, 6.634897), (2, 5.991465, 9.210340),
                           (5, 11.070498, 15.086272), (10, 18.307038, 23.209251)]:
        assert math.exp(chi.log_p_value(five, dof)) == pytest.approx(0.05, rel=1e-5)
        assert math.exp(chi.log_p_value(one, dof)) == pytest.approx(0.01, rel=1e-5)
    assert chi.log_p_value(0.0, 3) == 0.0
    assert chi.log_p_value(5.0, 0) == 0.0
    # far past the smallest double, still ordered and continuous
    assert chi.log_p_value(5000, 1) > chi.log_p_value(5001, 1) > chi.log_p_value(6000, 1)
    assert chi.log_p_value(1199.99, 1) == pytest.approx(
        chi.log_p_value(1200.01, 1), abs=0.05)


def test_shared_folder_is_the_configured_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == named
    assert session.new_folder(spark, "x").startswith(named + "/x-")


def test_materialise_keeps_rows(spark):
    df = session.materialise(spark.range(100))
    assert df.agg(F.sum("id")).first()[0] == 4950
    assert "range" not in df._jdf.queryExecution().toString().lower()


def test_the_shared_folder_names_its_store(spark, tmp_path):
    """An address without a store is the default store's, not this machine's."""
    plain = session.shared_folder(spark)
    assert plain.startswith("/") and session.exists(spark, plain)
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    (tmp_path / "ck").mkdir()
    settings.set("fs.viewfs.mounttable.own.link./ck", f"file://{tmp_path}/ck")
    settings.set("fs.defaultFS", "viewfs://own/")
    try:
        assert session._resolved(spark, "/ck/x") == "viewfs://own/ck/x"
        assert session._resolved(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    finally:
        settings.set("fs.defaultFS", before)


def test_lookup_joins_hot_keys_and_the_rest(spark):
    """A third of the rows in one key, nulls, keys that are not there, clashing names."""
    from classweave.functions.joins import lookup
    df = spark.range(9000).select(
        "id", F.lit("x").alias("n"), F.when(F.col("id") % 3 == 0, "hot").when(
            F.col("id") % 7 == 0, F.lit(None)).otherwise(
            (F.col("id") % 2000).cast("string")).alias("k"))
    table = df.filter("k is not null and k not like '11%'").groupBy(
        F.col("k").alias("key")).agg(F.count("*").alias("rows"), F.min("id").alias("least"))
    found = lookup(df, F.col("k"), table, "rows", 9000)
    assert found.columns == ["id", "n", "k", "least"] and found.count() == 9000
    want = df.join(table, df.k == table.key, "left").select("id", "n", "k", "least")
    assert found.exceptAll(want).count() == 0
    assert lookup(df, F.col("k"), table.limit(0), "rows", 0).filter("least is null").count() == 9000
