import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from classweave.operators import clean, evaluate, features, profile, sampling


# --- profiling ---------------------------------------------------------------

def test_missing_covers_null_and_nan_by_type(spark):
    df = spark.createDataFrame(
        [(1.0, "a", 1), (float("nan"), None, None), (None, "c", 3)],
        "x double, s string, i int")
    found = {r["column"]: (r["n_rows"], r["n_missing"])
             for r in profile.null_audit(df).collect()}
    assert found == {"x": (3, 2), "s": (3, 1), "i": (3, 1)}


def test_describe_mixed(spark):
    df = spark.createDataFrame([(1, "b"), (3, "a"), (None, None)], "n int, s string")
    found = {r["column"]: r for r in profile.describe(df).collect()}
    assert (found["n"]["count"], found["n"]["mean"], found["n"]["max"]) == (2, 2.0, 3.0)
    assert found["n"]["stddev"] == pytest.approx(math.sqrt(2))
    assert (found["s"]["min_text"], found["s"]["max_text"], found["s"]["mean"]) == ("a", "b", None)


def test_describe_sets_nan_aside(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = profile.describe(df).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (2, 2.0, 1.0, 3.0)
    assert row["stddev"] == pytest.approx(math.sqrt(2))


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(2, 1, 3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want, edges = np.histogram(values, bins=25)
    got = sorted(profile.histogram(df, "v", 25).collect(), key=lambda r: r["bin"])
    assert [r["n"] for r in got] == want.tolist()
    assert got[0]["lo"] == pytest.approx(edges[0])
    assert got[-1]["hi"] == pytest.approx(edges[-1])


def test_histogram_of_constant_and_empty(spark):
    one = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [r["n"] for r in profile.histogram(one, "v").collect()] == [2]
    assert profile.histogram(one.limit(0), "v", 5).count() == 0


def test_whole_numbers_get_bins_of_at_least_one(spark):
    df = spark.range(100_000).select((F.col("id") % 40).cast("int").alias("v"))
    assert profile.automatic_bins(df, "v") <= 39


def test_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 4000)], "v double")
    binned = sorted(profile.density(df, "v").collect(), key=lambda r: r["i"])
    exact = sorted(profile.density(df, "v", bins=None).collect(), key=lambda r: r["i"])
    step = binned[1]["x"] - binned[0]["x"]
    assert sum(r["density"] for r in binned) * step == pytest.approx(1, abs=0.03)
    worst = max(abs(a["density"] - b["density"]) for a, b in zip(binned, exact))
    assert worst < 1e-4


def test_correlation_is_the_same_at_any_width(spark):
    columns = [f"c{i}" for i in range(14)]
    df = spark.range(400).select(*(
        F.when(F.col("id") % 9 == i, F.lit(None if i % 2 else float("nan"))).otherwise(
            (F.abs(F.xxhash64("id", F.lit(i))) % 1000).cast("double")).alias(c)
        for i, c in enumerate(columns)))
    wide = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, columns).collect()}
    few = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, columns[:3]).collect()}
    assert len(wide) == 196
    for pair, value in few.items():
        assert wide[pair] == pytest.approx(value, abs=1e-9)
    assert not any(v is None or v != v for v in wide.values())
    for (x, y), value in wide.items():
        both = df.filter(f"{x} is not null and {y} is not null and not isnan({x}) "
                         f"and not isnan({y})")
        if x < y and columns.index(x) < 4:
            assert value == pytest.approx(both.agg(F.corr(x, y)).first()[0], abs=1e-12)


def test_correlation_without_spread_or_rows(spark):
    """Constants, constants in the shared rows only, large offsets, one row, none."""
    df = spark.range(200).select(
        F.lit(7).alias("same"), (F.col("id") + 10**9).cast("double").alias("far"),
        F.when(F.col("id") < 50, 0.1).alias("few"),
        F.when(F.col("id") >= 150, F.col("id")).alias("late"),
        (F.col("id") * -3).cast("int").alias("down"))
    got = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, df.columns).collect()}
    assert len(got) == 25
    assert got["far", "down"] == pytest.approx(-1, abs=1e-9)
    assert got["late", "far"] == pytest.approx(1, abs=1e-9) == got["late", "late"]
    for x in df.columns:
        assert got["same", x] is None and got["few", x] is None
    for few in (df.limit(1), df.limit(0)):
        assert all(r["corr"] is None for r in profile.correlation_matrix(
            few, df.columns).collect())


def test_correlation_reads_the_rows_twice_at_any_width(spark, tmp_path):
    """Forty columns are no more passes than two."""
    path = str(tmp_path / "wide")
    spark.range(300).select(*(
        (F.abs(F.xxhash64("id", F.lit(i))) % 100).alias(f"c{i}") for i in range(40)
    )).write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for width in (2, 40):
        spark.sparkContext.setJobGroup(f"corr{width}", "")
        profile.correlation_matrix(spark.read.parquet(path), [f"c{i}" for i in range(width)])
        jobs.append(len(tracker.getJobIdsForGroup(f"corr{width}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_one_far_value_makes_no_row_per_bin(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") == 0, 1e13).otherwise(F.col("id") % 100).alias("v"))
    assert profile.automatic_bins(df, "v") > 10**9
    found = profile.histogram(df, "v").collect()
    assert sum(r["n"] for r in found) == 10_000 and len(found) <= 101
    assert max(r["bin"] for r in found) > 2**31
    beyond = df.withColumn("v", F.col("v") * 1e300)
    assert sum(r["n"] for r in profile.histogram(beyond, "v", 10**12).collect()) == 10_000


def test_density_equals_the_whole_sum(spark):
    """Kernels cut at their reach, on a clump and a far value that leave a gap."""
    values = np.concatenate([np.random.default_rng(6).normal(0, 1, 900), [400.0, 401.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = sorted(profile.density(df, "v", grid=60, bins=None).collect(), key=lambda r: r["i"])
    assert [r["i"] for r in found] == list(range(60))
    width = values.std(ddof=1) * len(values) ** -0.2
    for r in found:
        z = (r["x"] - values) / width
        want = np.exp(-0.5 * z * z).sum() / (len(values) * width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, abs=1e-15)


@pytest.mark.parametrize("points", [1, 37, 10**6])
def test_scatter_points_are_bounded_and_stable(spark, points):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("x"), F.when(
        F.col("id") % 5 != 0, F.col("id")).alias("y"))
    got = {tuple(r) for r in profile.scatter_points(df, "x", "y", ["id"], points).collect()}
    again = {tuple(r) for r in profile.scatter_points(
        df.repartition(7), "x", "y", ["id"], points).collect()}
    assert got == again and len(got) == min(points, 400)


@pytest.mark.parametrize("window_rows", [13, 10_000])
def test_roc_corners_draw_the_same_curve(spark, window_rows):
    """Long runs of one class and equal steps in a row leave no points."""
    df = spark.range(4000).select(
        F.floor(F.col("id") / 3).alias("score"),
        ((F.floor(F.col("id") / 100) % 3 == 0) | (F.col("id") % 2 == 0)
         & (F.col("id") > 3000)).cast("int").alias("label"))
    every = evaluate.roc_points(df, window_rows=window_rows).orderBy(F.desc("threshold")).collect()
    turns = evaluate.roc_corners(df, window_rows=window_rows).orderBy(
        F.desc("threshold")).collect()
    assert set(turns) <= set(every) and 20 < len(turns) < len(every) / 2

    def area(points):
        x, y = ([0.0, *(p[n] for p in points)] for n in ("fpr", "tpr"))
        return np.trapezoid(y, x)

    assert area(turns) == pytest.approx(area(every), abs=1e-12)
    steps = [(0, 0), *((p["fp"], p["tp"]) for p in turns)]
    for (a, b), (c, d), (e, f) in zip(steps, steps[1:], steps[2:]):
        assert (c - a) * (f - d) != (e - c) * (d - b)
    one = df.filter("label = 1")
    assert len(evaluate.roc_corners(one).collect()) == 1
    assert evaluate.roc_corners(df.limit(0)).count() == 0


def test_equal_counts_name_two_classes(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)] * 5, "label double")
    row = profile.class_ratio(df).first()
    assert {row["majority_label"], row["minority_label"]} == {0.0, 1.0}
    assert row["ratio"] == 1.0


# --- cleaning ----------------------------------------------------------------

def test_all_null_column_has_no_fence(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    fences = clean.fit_fences(df, ["a", "b"], 0)
    assert fences.empty == ("b",)
    assert fences.filter(df).count() == 2


def test_zero_iqr_is_reported_and_can_be_skipped(spark):
    df = spark.createDataFrame([(3,)] * 9 + [(4,)], "r int")
    strict = clean.fit_fences(df, ["r"], 0)
    assert strict.flat == ("r",) and strict.filter(df).count() == 9
    assert clean.fit_fences(df, ["r"], 0, skip_flat=True).filter(df).count() == 10


def test_null_is_dropped_by_filter_and_marked_by_flag(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (900.0,)], "v double")
    fences = clean.fit_fences(df.filter("v < 100 OR v IS NULL"), ["v"], 0)
    assert sorted(r["v"] for r in fences.filter(df).collect()) == [1.0, 2.0, 3.0]
    flagged = fences.flag(df)
    assert flagged.count() == 5
    assert flagged.filter("is_outlier").count() == 2
    staged = fences.stage().transform(df)
    assert staged.exceptAll(flagged).count() == 0


@pytest.mark.parametrize("strategy,want", [("mean", 3.0), ("median", 2.0), ("mode", 2.0)])
def test_imputation(spark, strategy, want):
    df = spark.createDataFrame(
        [(2.0,), (2.0,), (5.0,), (float("nan"),), (None,)], "v double")
    fills = clean.fit_fills(df, ["v"], strategy, 0)
    assert fills.values["v"] == want
    assert [r["v"] for r in fills.apply(df).collect()] == [2.0, 2.0, 5.0, want, want]


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([(7,), (3,), (7,), (3,), (9,)], "v int")
    assert clean.fit_fills(df, ["v"], "mode").values["v"] == 3.0


# --- sampling ----------------------------------------------------------------

def labelled(spark, positives, negatives):
    n = positives + negatives
    return spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") < positives).cast("double").alias("label"))


def test_balance_keeps_the_whole_minority(spark):
    df = labelled(spark, 300, 3000)
    balanced = sampling.balance_classes(df, ["key"])
    counts = {r["label"]: r["count"] for r in balanced.groupBy("label").count().collect()}
    assert counts[1.0] == 300 and 240 < counts[0.0] < 360
    union, majority, minority = sampling.balanced_union(df, ["key"])
    assert union.exceptAll(balanced).count() == 0
    assert majority.count() + minority.count() == balanced.count()
    again = sampling.balance_classes(df.repartition(7), ["key"])
    assert again.exceptAll(balanced).count() == 0


def test_equal_classes_are_both_kept(spark):
    balanced = sampling.balance_classes(labelled(spark, 50, 50), ["key"])
    assert balanced.count() == 100


def test_one_class_cannot_be_balanced(spark):
    with pytest.raises(ValueError, match="two classes"):
        sampling.balance_classes(labelled(spark, 0, 50), ["key"])


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    train, test = sampling.split(df, ["key"])
    assert train.unionByName(test).distinct().count() == 2000
    assert train.count() + test.count() == 2000
    assert 1500 < train.count() < 1700
    folds = sampling.with_fold(df, ["key"], 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and all(r["count"] > 300 for r in folds)


# --- features ----------------------------------------------------------------

def test_index_order_and_ties(spark):
    df = spark.createDataFrame(
        [("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    got = [(r["category"], r["idx"]) for r in
           features.category_index(df, ["s"]).orderBy("idx").collect()]
    assert got == [("c", 0.0), ("a", 1.0), ("b", 2.0)]


def cells(spark):
    return spark.range(5000).select(
        (F.col("id") % 10).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        F.lit(1.0).alias("constant"),
        (F.abs(F.xxhash64("id")) % 3).cast("double").alias("noise"),
        ((F.col("id") % 10 > 6) | (F.abs(F.xxhash64("id", F.lit(1))) % 9 == 0))
        .cast("double").alias("label"))


def test_slot_tests_equal_mllib(spark):
    df = cells(spark)
    names = ["a", "b", "constant", "noise"]
    renamed = df.select("label", *(F.col(c).alias(f"{c}_num") for c in names))
    cuts = {"a": list(range(1, 10)), "b": list(range(1, 7)), "constant": [],
            "noise": [1, 2]}
    learned = features.learn(renamed, cuts, [], "label")
    vectors = df.select("label", array_to_vector(F.array(*names)).alias("v"))
    theirs = {r["featureIndex"]: r for r in
              features.chi_square_tests(vectors, "v", "label").collect()}
    for i, name in enumerate(names):
        ours = learned.tests[f"{name}_scaled"]
        assert ours.statistic == pytest.approx(theirs[i]["statistic"], rel=1e-9)
        assert ours.dof == theirs[i]["degreesOfFreedom"]
        assert math.exp(ours.log_p) == pytest.approx(theirs[i]["pValue"], rel=1e-6, abs=1e-300)
    slots = [f"{n}_scaled" for n in names]
    selector = UnivariateFeatureSelector(
        featuresCol="v", labelCol="label", selectionMode="numTopFeatures"
    ).setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(2)
    picked = sorted(selector.fit(vectors).selectedFeatures)
    assert features.select_slots(learned, slots, 2) == picked
    assert features.select_slots_by_value(vectors, "v", "label", 2) == picked
    table = {r["feature"]: r for r in
             features.chi_square_table(df, names, "label").collect()}
    assert table["a"]["statistic"] == pytest.approx(learned.tests["a_scaled"].statistic)
    assert (table["constant"]["statistic"], table["constant"]["dof"]) == (0.0, 0)


# --- evaluation --------------------------------------------------------------

def scores(spark, rows=800):
    return spark.range(rows).select(
        ((F.abs(F.xxhash64("id")) % 60) / 10.0).alias("score"),
        (F.abs(F.xxhash64("id", F.lit(2))) % 100 < 10 * (F.abs(F.xxhash64("id")) % 60) / 10)
        .cast("double").alias("label"))


def test_area_equals_the_exact_evaluator(spark):
    df = scores(spark)
    raw = df.withColumn("rawPrediction", F.col("score"))
    want = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    assert evaluate.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert evaluate.auc(df, window_rows=9).first()["auc"] == pytest.approx(want, abs=1e-12)
    reverse = df.withColumn("score", -F.col("score"))
    assert evaluate.auc(reverse).first()["auc"] == pytest.approx(1 - want, abs=1e-12)


def test_area_needs_two_classes(spark):
    one = scores(spark, 20).withColumn("label", F.lit(1.0))
    assert evaluate.auc(one).first()["auc"] is None


def test_metrics_without_positives_are_zero(spark):
    none_predicted = spark.createDataFrame(
        [(0.0, 1.0), (0.0, 0.0)], "prediction double, label double")
    none_true = spark.createDataFrame([(0.0, 0.0)], "prediction double, label double")
    for df in (none_predicted, none_true):
        counts = evaluate.confusion(df)
        assert evaluate.rates(counts).first() == (0.0, 0.0, 0.0)
    row = evaluate.sensitivity_specificity(evaluate.confusion(none_true)).first()
    assert (row["sensitivity"], row["specificity"]) == (0.0, 1.0)


def test_roc_ends_at_one(spark):
    points = evaluate.roc_points(scores(spark)).orderBy("threshold").collect()
    assert (points[0]["tpr"], points[0]["fpr"]) == (1.0, 1.0)
    assert all(a["tpr"] >= b["tpr"] and a["fpr"] >= b["fpr"]
               for a, b in zip(points, points[1:]))
