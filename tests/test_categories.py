"""Columns with more categories than a model lists: tables, joins, vectors."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from classweave.functions.chi import chi_square, log_p_value
from classweave.operators import categories, features
from classweave.plans import scoring, training
from classweave.spec import EMPLOYEE, FeatureSpec
from employees import employees

SPEC = FeatureSpec(("x",), ("city", "kind", "shop"), "y", ("key",))


def rows(spark, n=6000):
    """A third of the rows in one city, quotes in names, nulls, a planted shop."""
    return spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 17).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 7, F.lit(None))
        .otherwise(F.concat(F.lit("it's \\"), (F.col("id") % 400).cast("string"))).alias("city"),
        (F.col("id") % 2).cast("string").alias("kind"),
        (F.col("id") % 300).cast("string").alias("shop"),
        F.when((F.col("id") % 300).isin(5, 9, 11) | (F.col("id") % 31 == 0), "Yes")
        .otherwise("No").alias("y"))


def test_selection_equals_the_path_that_lists_all(spark):
    df = rows(spark)
    listed = training.fit_prep(df, SPEC)
    kept = training.fit_prep(df, SPEC, max_categories=50)
    assert set(kept.learned.best) == {"city", "shop"} and not listed.learned.best
    assert set(kept.learned.categories) == {"kind"}
    assert kept.selected_slots == listed.selected_slots
    assert {"shop=5", "shop=9", "shop=11"} <= set(kept.selected_slots)
    for slot in kept.selected_slots:
        assert kept.learned.tests[slot] == listed.learned.tests[slot]
    both = kept.transform(listed.transform(df).select(
        *df.columns, F.col("selectedFeatures").alias("other")))
    assert both.filter(
        vector_to_array("selectedFeatures") != vector_to_array("other")).count() == 0


def test_sparse_vectors_equal_the_listed_ones(spark):
    df = rows(spark)
    listed, kept = (training.fit_prep(df, SPEC, max_categories=n) for n in (10_000, 50))
    new = df.unionByName(df.limit(1).withColumns({
        "key": F.lit(-1).cast("long"), "shop": F.lit("unseen"),
        "kind": F.lit(None).cast("string")}))
    made = training.all_features(new, kept, ["key"])
    plain = listed.transform(new).select(
        "key", vector_to_array("features").alias("want"))
    assert made.count() == 6001
    gap = made.select("key", vector_to_array("features").alias("got")).join(plain, "key").filter(
        (F.size("got") != F.size("want")) | F.exists(
            F.arrays_zip("got", "want"), lambda p: F.abs(p["got"] - p["want"]) > 1e-12))
    assert gap.count() == 0
    parts = made.select(F.unwrap_udt("features").alias("v"))
    assert parts.select(F.max(F.size("v.indices"))).first()[0] == 4


def test_a_saved_model_scores_without_the_table(spark, tmp_path):
    df = rows(spark)
    model = training.train_model(df, SPEC, max_categories=50)
    scoring.save_model(model, str(tmp_path / "m"))
    before = scoring.score(df, model, ["key"])
    after = scoring.score(df, scoring.load_model(str(tmp_path / "m")), ["key"])
    assert after.count() == 6000 and before.exceptAll(after).count() == 0
    assert "Join" not in after._jdf.queryExecution().optimizedPlan().toString()


def test_a_million_categories(spark):
    """Most categories are met once, a planted one often."""
    n = 1_200_000
    df = spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 5).cast("double").alias("x"),
        F.when(F.col("id") % 6 == 0, "planted").otherwise(F.col("id").cast("string")).alias("who"),
        F.when((F.col("id") % 6 == 0) | (F.col("id") % 7 == 0), "Yes").otherwise("No").alias("y"))
    spec = FeatureSpec(("x",), ("who",), "y", ("key",))
    prep = training.fit_prep(df, spec, top=3)
    assert prep.learned.table.sizes["who"] == 1_000_001
    assert prep.learned.categories == {} and len(prep.learned.best["who"]) == 3
    assert len(prep.slots) == 4
    assert "who=planted" in prep.selected_slots
    found = training.all_features(df.limit(1000), prep, ["key"])
    sizes = found.select(F.unwrap_udt("features")["size"].alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [1_000_002]


def test_statistics_and_order(spark):
    cells = spark.createDataFrame(
        [("c", None if i == 9 else f"v{i}", i * 3 % 7, i) for i in range(12)]
        + [("d", "all", 31, 66), ("other", "v1", 5, 5)],
        "feature string, category string, n0 long, n1 long")
    classes = (31, 66)
    table = categories.category_table(cells, ["c", "d", "gone"], classes)
    assert table.sizes == {"c": 11, "d": 1, "gone": 0}
    found = {r["category"]: r for r in table.rows.filter("column = 'c'").collect()}
    order = sorted(found.values(), key=lambda r: (-(r["n0"] + r["n1"]), r["category"]))
    assert [r["idx"] for r in order] == list(map(float, range(11)))
    for r in found.values():
        want, dof = chi_square([(r["n0"], r["n1"]), (31 - r["n0"], 66 - r["n1"])])
        assert r["statistic"] == pytest.approx(want, rel=1e-12)
    best = table.best(["c", "d"], 4)
    logs = [log_p_value(r["statistic"], 1) for r in best]
    assert logs == sorted(logs) and len(best) == 4
    assert table.rows.filter("column = 'd'").first()["statistic"] == 0.0


def test_joins_spread_what_matches_nothing(spark):
    df = rows(spark).select("key", "city")
    cells = features.feature_cells(
        df.withColumn("label", F.lit(1.0)), {}, ["city"], "label")
    table = categories.category_table(cells, ["city"], (0, 6000))
    joined = categories.with_indices(df, table, ["city"])
    assert joined.columns == ["key", "city", "city_index"] and joined.count() == 6000
    wrong = joined.join(table.rows.withColumnRenamed("category", "city"), "city", "left").filter(
        ~F.col("idx").eqNullSafe(F.col("city_index")))
    assert wrong.count() == 0


def test_employees_under_any_bound(spark):
    staff = employees(spark, 1200)
    listed, kept = (training.fit_prep(
        staff, EMPLOYEE, skip_flat=True, max_categories=n) for n in (100, 3))
    assert kept.learned.best and kept.selected_slots == listed.selected_slots


@pytest.mark.parametrize("options", [{"unseen": "error"}, {"binned": False}])
def test_what_a_table_cannot_do_is_refused(spark, options):
    with pytest.raises(ValueError, match="more than 50"):
        training.fit_prep(rows(spark), SPEC, max_categories=50, **options)
