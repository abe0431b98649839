import json
import subprocess
import sys
import time
from dataclasses import replace

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    MinMaxScaler,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from classweave.operators import evaluate, models
from classweave.plans import scoring, training
from classweave.sources import records
from classweave.spec import EMPLOYEE, FeatureSpec, employee_schema
from classweave.streaming import requests
from employees import employees


@pytest.fixture(scope="module")
def staff(spark):
    return employees(spark, 1500).cache()


@pytest.fixture(scope="module")
def data(staff):
    return training.build_training_set(staff, EMPLOYEE, folds=3, skip_flat=True)


@pytest.fixture(scope="module")
def model(staff):
    return training.train_model(staff, EMPLOYEE, skip_flat=True)


def test_preparation_finds_the_planted_reason(data):
    assert "OverTime=Yes" in data.prep.selected_slots
    assert "MonthlyIncome_scaled" in data.prep.selected_slots
    assert len(data.prep.selected) == 10
    assert len(data.prep.slots) == 23 + 3 + 3 + 4 + 2 + 3 + 3 + 2


def test_training_set_is_balanced_and_the_test_set_is_not(data, staff):
    counts = {r["label"]: r["count"] for r in
              data.train.groupBy("label").count().collect()}
    assert 0.7 < counts[0.0] / counts[1.0] < 1.4
    held_out = {r["label"]: r["count"] for r in
                data.test.groupBy("label").count().collect()}
    assert held_out[0.0] > 3 * held_out[1.0]


def test_rows_are_chosen_before_they_are_prepared(spark, small):
    """Rows that balancing leaves out get no vectors; the others are those of before."""
    from classweave.operators import sampling
    from classweave.plans import standins as s
    made = training.build_training_set(s.lines(spark, small), s.LINES, folds=5)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = made.train._jdf.queryExecution().analyzed().toString().split("\n")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    chosen = next(i for i, line in enumerate(plan)
                  if "Filter" in line and f", {sampling.SEED})" in line)
    vectors = [i for i, line in enumerate(plan) if "Project" in line and "_vec" in line]
    assert vectors and max(vectors) < chosen
    raw, _ = sampling.split(made.source, s.LINES.key)
    late = sampling.with_fold(sampling.balance_classes(
        training.prepare(raw, made.prep), s.LINES.key, balance=made.balance), s.LINES.key, 5)
    kept = [vector_to_array("selectedFeatures").alias("x"), "label", "fold"]
    ours, theirs = made.train.select(*kept), late.select(*kept)
    assert ours.count() == theirs.count() > 0
    assert ours.exceptAll(theirs).count() == 0
    made.release()


@pytest.mark.parametrize("unseen", ["keep", "error"])
def test_features_equal_stages_fitted_by_mllib(staff, unseen):
    """The two-scan preparation gives the vector of an ordinary fit."""
    prep = training.fit_prep(
        staff, EMPLOYEE, relative_error=0, skip_flat=True, unseen=unseen)
    inside = prep.fences.filter(staff)
    numeric, categorical = list(EMPLOYEE.numeric), list(EMPLOYEE.categorical)
    stages = [
        StringIndexer(inputCols=categorical, handleInvalid=unseen,
                      outputCols=[f"{c}I" for c in categorical]),
        OneHotEncoder(inputCols=[f"{c}I" for c in categorical],
                      outputCols=[f"{c}V" for c in categorical]),
        VectorAssembler(inputCols=numeric, outputCol="n"),
        MinMaxScaler(inputCol="n", outputCol="s"),
        VectorAssembler(inputCols=["s", *(f"{c}V" for c in categorical)],
                        outputCol="plain"),
    ]
    plain = Pipeline(stages=stages).fit(inside).transform(inside)
    both = prep.transform(plain.drop("n", "s")).select(
        vector_to_array("features").alias("ours"),
        vector_to_array("plain").alias("theirs"))
    width = 23 + sum(k if unseen == "keep" else k - 1 for k in (3, 3, 4, 2, 3, 3, 2))
    assert len(prep.slots) == width
    wrong = both.filter(
        (F.size("ours") != width) | (F.size("theirs") != width)
        | F.exists(F.arrays_zip("ours", "theirs"),
                   lambda p: F.abs(p["ours"] - p["theirs"]) > 1e-12))
    assert wrong.count() == 0


def test_value_by_value_selection(staff):
    prep = training.fit_prep(staff, EMPLOYEE, skip_flat=True, binned=False)
    assert "OverTime=Yes" in [s for s in prep.selected_slots]


def test_selection_copes_with_many_distinct_values(spark):
    df = spark.range(12_000).select(
        F.col("id").alias("key"), (F.col("id") * 1.5).alias("x"),
        F.when(F.col("id") > 9_000, "Yes").otherwise("No").alias("y"))
    spec = FeatureSpec(("x",), (), "y", ("key",))
    prep = training.fit_prep(df, spec, top=1)
    assert prep.selected_slots == ["x_scaled"]


def test_models_learn_and_metrics_agree(data):
    fitted = models.fit_models(
        data.train, **{"Random Forest": {"numTrees": 10},
                       "Gradient Boosting": {"maxIter": 3}})
    table = evaluate.compare_models(fitted, data.test)
    rows = {r["model"]: r for r in table.collect()}
    assert list(rows) == list(models.CLASSIFIERS)
    for name, model in fitted.items():
        want = BinaryClassificationEvaluator(numBins=0).evaluate(
            model.transform(data.test))
        assert rows[name]["auc"] == pytest.approx(want, abs=1e-9)
        assert rows[name]["auc"] > 0.7
        assert 0 < rows[name]["f1"] <= 1
    best = evaluate.best_model(table).first()
    assert best["auc"] == max(r["auc"] for r in rows.values())


def test_checks_prepare_the_test_rows_once(data, spark):
    """The shared pass and a pass for each model read rows that were written once."""
    from pyspark.sql.functions import udf
    from classweave.plans import queries_models as q
    prepared = spark.sparkContext.accumulator(0)

    @udf("double")
    def counted(label):
        prepared.add(1)
        return label

    fitted = models.fit_models(data.train, ["Logistic Regression", "Decision Tree"])
    rows = data.test.withColumn("label", counted("label"))
    found = q._checks(fitted, rows).collect()
    held = {r["label"]: r["count"] for r in data.test.groupBy("label").count().collect()}
    assert prepared.value == held[0.0] + held[1.0]
    assert {r["model"] for r in found} == set(fitted)
    assert all((r["pos"], r["neg"]) == (held[1.0], held[0.0]) and r["rates_hold"]
               and r["best_is_first"] for r in found)


def test_grid_has_eighteen_points():
    assert len(models.logistic_grid(models.logistic_regression())) == 18


def test_cross_validation(data, spark):
    estimator = models.logistic_regression(maxIter=10)
    grid = models.logistic_grid(estimator)[::6]
    tuned = models.cross_validate(data.train, estimator, grid, folds=3)
    table = tuned.table(spark).collect()
    assert len(table) == 3 and all(r["folds"] == 3 for r in table)
    assert max(r["auc"] for r in table) == pytest.approx(
        {r["params"]: r["auc"] for r in table}[
            models.describe_params(tuned.best_params)])
    # the shared pass agrees with the exact evaluator on one fold
    fold = data.train.filter("fold = 0")
    one = estimator.fit(data.train.filter("fold <> 0"), grid[0])
    want = BinaryClassificationEvaluator(numBins=0).evaluate(one.transform(fold))
    assert models.fold_areas([one], fold, "label")[0] == pytest.approx(want, abs=1e-12)
    name = models.describe_params(grid[0])
    assert {(p, f): a for p, f, a, *_ in tuned.scores}[name, 0] == pytest.approx(want, abs=1e-12)


def test_areas_of_many_groups_are_those_of_each(spark):
    df = spark.range(3000).select(
        (F.col("id") % 7).alias("model"), (F.col("id") % 3).alias("fold"),
        (F.xxhash64("id") % 200).alias("score"),
        # group 6 has one class only
        F.when(F.col("id") % 7 == 6, 0).otherwise(F.hash("id") % 2).alias("label"))
    df = df.withColumn("label", F.abs("label"))
    for window_rows in (50, 10**6):
        found = evaluate.auc(df, window_rows=window_rows, by=["model", "fold"]).collect()
        assert len(found) == 21
        for r in found:
            own = df.filter((F.col("model") == r["model"]) & (F.col("fold") == r["fold"]))
            assert evaluate.auc(own).first()["auc"] == r["auc"]
            assert (r["auc"] is None) == (r["model"] == 6)


class Interrupted(Exception):
    pass


def test_a_search_goes_on_where_it_stopped(data, monkeypatch, tmp_path):
    estimator = models.decision_tree()
    grid = models.tree_grid(estimator)
    whole = models.cross_validate(data.train, estimator, grid, folds=2, parallelism=1)
    fitted, plain = [], type(estimator).fit

    def fit(self, rows, params=None):
        if len(fitted) == stop:
            raise Interrupted
        fitted.append(models.describe_params(params))
        return plain(self, rows, params)

    monkeypatch.setattr(type(estimator), "fit", fit)
    place = dict(folds=2, parallelism=1, ledger=str(tmp_path / "ledger"))
    stop = 5
    with pytest.raises(Interrupted):
        models.cross_validate(data.train, estimator, grid, **place)
    # an entry that was cut off has no end marker
    book = models.Ledger.open(place["ledger"], data.train, estimator, 2, "fold")
    cut = book.entry(fitted[0], 0)
    (tmp_path / "ledger").joinpath(*cut.split("/")[-3:], "_SUCCESS").unlink()
    stop = None
    resumed = models.cross_validate(data.train, estimator, grid, **place)
    assert len(fitted) == 5 + (8 - 5 + 1) + 1 and fitted.count(fitted[0]) >= 2
    assert resumed.scores == whole.scores
    again = models.cross_validate(data.train, estimator, grid, **place)
    assert len(fitted) == 10 and again.scores == whole.scores
    rows = data.test.limit(50)
    assert [r.probability for r in again.best_model.transform(rows).collect()] == [
        r.probability for r in whole.best_model.transform(rows).collect()]
    # other rows or settings are another search
    other = models.Ledger.open(
        place["ledger"], data.train.limit(100), estimator, 2, "fold")
    assert other.folder != book.folder
    assert models.Ledger.open(place["ledger"], data.train, models.decision_tree(maxBins=16),
                              2, "fold").folder != book.folder


KILLED = """
import sys
sys.path[:0] = {path!r}
from pyspark.sql import SparkSession, functions as F
from pyspark.ml.functions import array_to_vector
from classweave.operators import models
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
rows = spark.read.parquet({rows!r}).withColumn("selectedFeatures", array_to_vector("x"))
estimator = models.decision_tree()
models.cross_validate(rows.cache(), estimator, models.tree_grid(estimator), folds=5,
                      parallelism=1, ledger={ledger!r})
"""


def test_a_killed_search_is_resumed(data, spark, tmp_path):
    """The driver dies after some fits; another one does the rest."""
    data.train.select(vector_to_array("selectedFeatures").alias("x"), "label", (
        F.abs(F.hash("selectedFeatures")) % 5).alias("fold")).write.parquet(str(tmp_path / "rows"))
    ledger, marks = str(tmp_path / "ledger"), []
    script = KILLED.format(path=sys.path, shared=str(tmp_path / "shared"),
                           rows=str(tmp_path / "rows"), ledger=ledger)
    victim = subprocess.Popen([sys.executable, "-c", script],
                              stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    end = time.monotonic() + 120
    while len(marks) < 3 and victim.poll() is None and time.monotonic() < end:
        time.sleep(0.05)
        marks = list((tmp_path / "ledger").glob("*/fold-*/*/_SUCCESS"))
    victim.kill()
    victim.wait()
    assert 3 <= len(marks) < 20
    written = [mark.stat().st_mtime_ns for mark in marks]
    rows = spark.read.parquet(str(tmp_path / "rows")).withColumn(
        "selectedFeatures", array_to_vector("x"))
    estimator = models.decision_tree()
    tuned = models.cross_validate(
        rows, estimator, models.tree_grid(estimator), folds=5, ledger=ledger)
    assert len(tuned.scores) == 20
    assert [mark.stat().st_mtime_ns for mark in marks] == written
    assert sum(pos + neg for _, _, _, pos, neg in tuned.scores) == 4 * rows.count()


def test_a_search_fits_in_few_tasks(data, monkeypatch):
    """Rows in many partitions are held in few, folds beside each other."""
    estimator = models.logistic_regression()
    grid = models.logistic_grid(estimator)[:2]
    plain = models.cross_validate(data.train, estimator, grid, folds=3)
    seen, fit = [], type(estimator).fit

    def counted(self, rows, params=None):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return fit(self, rows, params)

    monkeypatch.setattr(type(estimator), "fit", counted)
    spread = data.train.repartition(12).persist()
    tuned = models.cross_validate(spread, estimator, grid, folds=3, tasks=2)
    spread.unpersist()
    assert len(seen) == 2 * 3 + 1 and {n for n, _ in seen} == {2}
    # whole folds: each row trains all folds but its own, and the winner
    assert sum(n for _, n in seen) == (2 * 2 + 1) * data.train.count()
    judged = {(p, f): (a, pos, neg) for p, f, a, pos, neg in plain.scores}
    for p, f, a, pos, neg in tuned.scores:
        assert (pos, neg) == judged[p, f][1:] and a == pytest.approx(judged[p, f][0], abs=1e-6)


def loss_of(model, rows, point):
    """The mean loss on ``rows`` with the penalty of the grid point, by its definition."""
    import numpy as np
    held = rows.select(vector_to_array("selectedFeatures").alias("x"), "label").toPandas()
    x, y = np.array(held["x"].tolist()), held["label"].to_numpy()
    at = {p.name: v for p, v in point.items()}
    w = model.coefficients.toArray()
    margin = x @ w + model.intercept
    scaled = w * x.std(axis=0, ddof=1)
    mix = at["elasticNetParam"]
    return (np.logaddexp(0, margin) - y * margin).mean() + at["regParam"] * (
        mix * np.abs(scaled).sum() + (1 - mix) / 2 * (scaled ** 2).sum())


def test_fits_side_by_side_are_those_of_mllib(data):
    """Grid points reach the least loss, which MLlib's own fit reaches if it may go on."""
    from classweave.operators import logistic
    estimator = models.logistic_regression()
    grid = models.logistic_grid(estimator)
    held = logistic.Rows(data.train, estimator, "fold")
    found = {}
    longer = {estimator.maxIter: 2000, estimator.tol: 1e-12}
    jobs = [(0, point) for point in grid[::4]] + [(None, point) for point in grid[1::8]]
    held.fit(jobs, found.__setitem__)
    held.release()
    assert sorted(found) == list(range(len(jobs)))
    for number, model in found.items():
        left_out, point = jobs[number]
        rows = data.train if left_out is None else data.train.filter("fold <> 0")
        want = estimator.fit(rows, {**point, **longer})
        reached, least = loss_of(model, rows, point), loss_of(want, rows, point)
        assert reached <= least + 1e-7
        # weights of columns that add up to one are not unique, chances are
        ours, theirs = (m.transform(rows).select(vector_to_array("probability")[1]).toPandas()
                        .to_numpy()[:, 0] for m in (model, want))
        assert ours == pytest.approx(theirs, abs=5e-3)
        assert model.uid == want.uid and model.getThreshold() == want.getThreshold()
        assert model.getRegParam() == want.getRegParam()
        if not want.getFitIntercept():
            assert model.intercept == 0


def test_a_search_side_by_side_starts_few_steps(data, spark, monkeypatch, tmp_path):
    """No fit of its own but the winner's; the areas and the ledger are as before."""
    estimator = models.logistic_regression()
    grid = models.logistic_grid(estimator)
    plain = models.cross_validate(data.train, estimator, grid[::5], folds=3)
    fitted, fit = [], type(estimator).fit
    monkeypatch.setattr(type(estimator), "fit", lambda self, rows, params=None: (
        fitted.append(params), fit(self, rows, params))[1])
    place = dict(folds=3, ledger=str(tmp_path / "ledger"), side_by_side=True)
    tuned = models.cross_validate(data.train, estimator, grid[::5], **place)
    assert fitted == [tuned.best_params] and len(tuned.scores) == 12
    for ours, theirs in zip(tuned.scores, plain.scores):
        assert ours[:2] == theirs[:2] and ours[3:] == theirs[3:]
        assert ours[2] == pytest.approx(theirs[2], abs=2e-3)
    # a wider search does what is missing only
    wider = models.cross_validate(data.train, estimator, grid, **place)
    assert len(wider.scores) == 54 and len(list((tmp_path / "ledger").glob("*/fold-*/*"))) == 54
    at = {s[:2]: s for s in wider.scores}
    assert all(at[s[:2]] == s for s in tuned.scores)
    # what only MLlib knows is left to it
    fitted.clear()
    models.cross_validate(data.train, models.logistic_regression(standardization=False),
                          grid[:1], folds=2, side_by_side=True)
    assert len(fitted) == 3


def test_scores_are_counted_as_by_mllib(data, monkeypatch):
    """The counts per distinct score, sorted in many stretches, are those of a grouping."""
    from classweave.operators import logistic
    monkeypatch.setattr(logistic, "SORTED_SCORES", 40)
    monkeypatch.setattr(logistic, "HELD_ROWS", 50)
    estimator = models.logistic_regression(maxIter=3)
    twice = data.train.union(data.train).repartition(4).persist()
    rows = logistic.Rows(twice, estimator, "fold")
    fitted = {}
    jobs = [(n, {}) for n in (0, 2, 0)]
    few = list(logistic._some_rows(logistic.Block(0, None, [1] * 20) for _ in range(8)))
    assert [len(some) for some in few] == [3, 3, 2]
    rows.fit(jobs, fitted.__setitem__)
    found = rows.counts([(jobs[i][0], fitted[i]) for i in range(3)]).toPandas()
    rows.release()
    for i, (n, _) in enumerate(jobs):
        want = evaluate.model_counts([fitted[i]], twice.filter(F.col("fold") == n)).orderBy(
            "score").toPandas()
        ours = found[found["model"] == i].sort_values("score")
        assert ours["score"].to_numpy() == pytest.approx(want["score"].to_numpy(), abs=1e-9)
        assert (ours[["pos", "neg"]].to_numpy() == want[["pos", "neg"]].to_numpy()).all()
    twice.unpersist()


def test_a_fold_without_a_class_is_left_to_mllib(data):
    """Rows of one class beside a fold of both: a constant model, as before."""
    rows = data.train.withColumn("fold", F.when(F.col("label") == 1, 0).otherwise(
        F.col("fold") % 2)).persist()
    estimator = models.logistic_regression(maxIter=5)
    grid = models.logistic_grid(estimator)[:1]
    plain, ours = (models.cross_validate(
        rows, estimator, grid, folds=2, side_by_side=s) for s in (False, True))
    rows.unpersist()
    assert plain.scores[0] == ours.scores[0] and plain.scores[0][2] == 0.5
    assert [s[2:] for s in plain.scores] == [s[2:] for s in ours.scores]


def test_deep_trees_come_first_and_the_winner_is_spread(data, monkeypatch):
    """A long fit that started last, or a refit in a fold's few tasks, would run alone."""
    estimator = models.decision_tree()
    grid = models.tree_grid(estimator)
    seen, fit = [], type(estimator).fit

    def noted(self, rows, params=None):
        seen.append((params[estimator.maxDepth], rows.rdd.getNumPartitions()))
        return fit(self, rows, params)

    monkeypatch.setattr(type(estimator), "fit", noted)
    spread = data.train.repartition(6).persist()
    models.cross_validate(spread, estimator, grid, folds=3, parallelism=1, tasks=1,
                          refit_tasks=4)
    spread.unpersist()
    depths = [depth for depth, _ in seen[:-1]]
    assert depths == [5] * 6 + [3] * 6
    assert [tasks for _, tasks in seen] == [1] * 12 + [4]


def test_boosting_fits_share_the_cores(spark, data):
    from classweave.plans import queries_models as q
    cores = spark.sparkContext.defaultParallelism
    assert q._fits_at_once(spark, data, "Gradient Boosting") == 2 * cores
    many = replace(data, balance=replace(data.balance, minority_count=cores * 2_000_000))
    assert q._fits_at_once(spark, many, "Gradient Boosting") == 1


def test_small_searches_run_beside_each_other(spark, data, monkeypatch):
    """Each waits until all have begun, which searches in turn never do."""
    from threading import Barrier
    from classweave.plans import queries_models as q
    begun = Barrier(len(models.CLASSIFIERS))

    def search(spark, data, name):
        begun.wait(30)
        return models.Tuned([(name, 0, 0.5, 1, 1)], {}, None)

    monkeypatch.setattr(q, "_tuned", search)
    monkeypatch.setattr(q, "_training_set", lambda *_, **__: data)
    monkeypatch.setattr(type(data), "release", lambda self: None)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(q, "_fit_tasks", lambda data, name: cores // 4)
    found = q.tune_models(spark, "nowhere").collect()
    assert {(r["model"], r["params"]) for r in found} == {(n, n) for n in models.CLASSIFIERS}
    monkeypatch.setattr(q, "_fit_tasks", lambda data, name: cores)
    assert q._searches_at_once(spark, data) == 1


def test_few_rows_take_one_task_and_fill_the_cores(spark, data):
    from classweave.plans import queries_models as q
    cores = spark.sparkContext.defaultParallelism
    assert q._fit_tasks(data, "Logistic Regression") == 1
    assert q._fits_at_once(spark, data, "Logistic Regression") == max(4, cores)
    many = replace(data, balance=replace(data.balance, minority_count=30_000_000))
    assert q._fit_tasks(many, "Logistic Regression") == 30
    assert q._fits_at_once(spark, many, "Logistic Regression") == max(4, -(-cores // 30))
    assert q._fits_at_once(spark, many, "Random Forest") == 1


def test_every_family_can_be_tuned(data):
    tuned = models.tune_all(
        data.train, ["Decision Tree"], folds=2)["Decision Tree"]
    assert len(tuned.scores) == 8 and tuned.best_model is not None


# --- scoring -----------------------------------------------------------------

def test_every_row_is_scored(spark, model):
    """One class, outliers, missing numbers and new categories included."""
    rows = employees(spark, 40, salt=3).withColumns({
        "Attrition": F.lit("No"),
        "MonthlyIncome": F.when(F.col("EmployeeNumber") == 1, 10_000_000)
        .otherwise(F.col("MonthlyIncome")),
        "DailyRate": F.when(F.col("EmployeeNumber") != 2, F.col("DailyRate")),
        "JobRole": F.when(F.col("EmployeeNumber") == 3, "Astronaut")
        .otherwise(F.col("JobRole")),
    })
    scored = {r["EmployeeNumber"]: r for r in
              scoring.score(rows, model, ["EmployeeNumber"]).collect()}
    assert len(scored) == 40
    assert all(0 <= r["p1"] <= 1 for r in scored.values())
    assert scored[1]["is_outlier"] and scored[2]["is_outlier"]
    assert not scored[3]["is_outlier"]


def test_scores_do_not_depend_on_the_batch(spark, model):
    rows = employees(spark, 30, salt=5)
    together = {r[0]: r[1] for r in scoring.score(rows, model, ["EmployeeNumber"])
                .select("EmployeeNumber", "p1").collect()}
    alone = scoring.score(rows.filter("EmployeeNumber = 4"), model).first()["p1"]
    assert alone == together[4]


def test_saved_model_scores_alike(spark, model, tmp_path):
    scoring.save_model(model, str(tmp_path / "m"))
    rows = employees(spark, 50, salt=2)
    before = scoring.score(rows, model).select("p1").collect()
    after = scoring.score(rows, scoring.load_model(str(tmp_path / "m"))).select("p1").collect()
    assert before == after


def request_lines(spark, rows):
    table = employees(spark, rows, salt=9)
    line = records.format_line(table, employee_schema())
    return table.select(
        records.encode_request(
            line, request_id=F.col("EmployeeNumber").cast("string"),
            client_type=F.lit("web")).alias("value"))


def test_two_requests_get_two_answers(spark, model):
    table = employees(spark, 1, salt=9).drop("OverTime", "MonthlyIncome").crossJoin(
        spark.createDataFrame([(2100, "Yes"), (18000, "No")],
                              "MonthlyIncome int, OverTime string"))
    line = records.format_line(table, employee_schema())
    leaving, staying = (r.line for r in table.orderBy("MonthlyIncome").select(
        line.alias("line")).collect())
    bodies = [json.dumps({"data": leaving}), json.dumps({"data": staying}),
              json.dumps({"data": "1,2"}), "oops"]
    df = spark.createDataFrame([(b,) for b in bodies], "value string")
    rows = scoring.score_requests(df, "value", employee_schema(), model).collect()
    likely, unlikely, short, broken = rows
    assert likely["p1"] > 0.5 > unlikely["p1"]
    answer = json.loads(likely["response"])
    assert answer["prediction"] == 1.0
    assert answer["probability"][1] == pytest.approx(likely["p1"])
    for bad in (short, broken):
        assert bad["malformed"] and bad["p1"] is None and bad["response"] is None
    assert len({r["request_id"] for r in rows}) == 4


def test_stream_equals_batch(spark, model, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    request_lines(spark, 60).repartition(4).write.text(source)
    def run():
        stream = requests.scored_stream(
            requests.request_stream(spark, source, files_per_trigger=2),
            employee_schema(), model, "v7")
        requests.start_scoring(stream, target, marks).awaitTermination()
    run()
    run()  # nothing new arrives, so nothing is scored twice
    streamed = spark.read.parquet(target)
    batch = scoring.score_requests(
        spark.read.text(source), "value", employee_schema(), model)
    columns = ["request_id", "prediction", "p1", "response", "malformed"]
    assert streamed.count() == 60
    assert streamed.select(*columns).exceptAll(batch.select(*columns)).count() == 0
    assert {r["model_version"] for r in streamed.collect()} == {"v7"}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batch_scores_are_judged_row_by_row(spark, small):
    """No row meets its expected score through a join or a list per key."""
    from classweave.plans import queries_models as q
    found = q.batch_score(spark, small)
    assert "Join" not in plan_of(found) and "collect_set" not in plan_of(found)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert sum(r["n_agree"] for r in found.collect()) == lines


def test_a_wrong_score_does_not_agree(spark):
    """Rows of one key may have any of its scores, however many; others none."""
    from classweave.plans import queries_models as q
    expected = spark.createDataFrame(
        [("a", [0.1, 0.2, 0.3], [0.0]), ("b", [0.7], [1.0])],
        "row string, wants array<double>, labels array<double>")
    scored = spark.createDataFrame(
        [("a", 0.2, 0.0), ("a", 0.3, 0.0), ("a", 0.25, 0.0), ("b", 0.7, 1.0),
         ("b", 1.5, 1.0), ("c", 0.7, 1.0)], "row string, p1 double, prediction double")
    got = q._score_counts(scored, expected).first()
    assert (got["n_rows"], got["n_scored"], got["n_agree"]) == (6, 5, 3)


def test_expected_scores_of_a_key_are_one_row(spark, small, tmp_path):
    from classweave.plans import queries_models as q
    from classweave.plans import standins as s
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    twice = lines.orderBy(*s.LINEITEM_KEY).limit(3).withColumn("l_quantity", F.lit(60.0))
    lines.unionByName(twice).unionByName(twice.withColumn(
        "l_quantity", F.lit(70.0))).write.parquet(str(tmp_path / "lineitem.parquet"))
    model = q._trained(spark, small)
    found = q._expected(spark, str(tmp_path), model, s.LINEITEM_KEY)
    assert "collect_set" in plan_of(found) and "Aggregate" not in plan_of(found)
    keys = lines.select(*s.LINEITEM_KEY).distinct().count()
    assert found.count() == keys
    assert found.filter(F.size("wants") >= 3).count() >= 3


def test_an_empty_share_needs_no_digest(spark):
    from classweave.functions.hashing import hash_between
    rows = spark.range(100)
    assert plan_of(rows.filter(hash_between(["id"], 1, 0.0, 0.8))).count("md5") == 1
    assert rows.filter(hash_between(["id"], 1, 0.0, 0.8)).count() + rows.filter(
        hash_between(["id"], 1, 0.8, 1.0)).count() == 100


def test_a_forest_search_grows_the_same_trees(data):
    from classweave.plans import queries_models as q
    plain, searched = (
        models.random_forest(numTrees=5, maxDepth=5, **more).fit(data.train)
        for more in ({}, q.SEARCH_SETTINGS["Random Forest"]))
    assert searched.getOrDefault("cacheNodeIds")
    assert (plain.toDebugString.split("\n", 1)[1]
            == searched.toDebugString.split("\n", 1)[1])
