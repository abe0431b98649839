"""The four classifiers, fitting them, and tuning by cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classweave.functions.running import SINGLE_WINDOW_ROWS
from classweave.operators import logistic
from classweave.operators.evaluate import areas, model_counts
from classweave.operators.ledger import Ledger
from classweave.operators.sampling import SEED
from classweave.session import materialise, new_folder, shared_folder

COLUMNS = {"featuresCol": "selectedFeatures", "labelCol": "label"}

# Trees, boosting rounds, iterations, the grid and the folds.
NUM_TREES = 100
BOOSTING_ROUNDS = 100
MAX_ITERATIONS = 100
REG_PARAM = [0.1, 0.01, 0.001]
FIT_INTERCEPT = [True, False]
ELASTIC_NET = [0.0, 0.5, 1.0]
FOLDS = 5

TREE_GRID = {"maxDepth": [3, 5], "minInstancesPerNode": [1, 10]}


def random_forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(
        **COLUMNS, **{"numTrees": NUM_TREES, "seed": SEED, **params})


def gradient_boosting(**params) -> GBTClassifier:
    """Each round builds on the last, so the lineage is cut every ten."""
    defaults = {"maxIter": BOOSTING_ROUNDS, "seed": SEED,
                "checkpointInterval": 10}
    return GBTClassifier(**COLUMNS, **{**defaults, **params})


def logistic_regression(**params) -> LogisticRegression:
    return LogisticRegression(
        **COLUMNS, **{"maxIter": MAX_ITERATIONS, **params})


def decision_tree(**params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(**COLUMNS, **{"seed": SEED, **params})


CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "Random Forest": random_forest,
    "Gradient Boosting": gradient_boosting,
    "Logistic Regression": logistic_regression,
    "Decision Tree": decision_tree,
}


def in_parallel(spark: SparkSession, jobs: Sequence[Callable],
                 parallelism: int) -> list:
    """Submit jobs from a few driver threads so that they share the cluster."""
    if parallelism <= 1:
        return [job() for job in jobs]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(parallelism) as pool:
        waiting = [pool.submit(inherit(job)) for job in jobs]
        return [w.result() for w in waiting]


def fit_models(train: DataFrame, names: Sequence[str] | None = None,
               parallelism: int = 4, **params: dict) -> dict[str, Model]:
    """Fit each named classifier on ``train``, which the caller persists."""
    shared_folder(train.sparkSession)  # boosting checkpoints go there
    names = list(names or CLASSIFIERS)
    estimators = [CLASSIFIERS[n](**params.get(n, {})) for n in names]
    fitted = in_parallel(
        train.sparkSession, [lambda e=e: e.fit(train) for e in estimators],
        parallelism)
    return dict(zip(names, fitted))


def logistic_grid(estimator: LogisticRegression) -> list[dict]:
    return (
        ParamGridBuilder()
        .addGrid(estimator.regParam, REG_PARAM)
        .addGrid(estimator.fitIntercept, FIT_INTERCEPT)
        .addGrid(estimator.elasticNetParam, ELASTIC_NET)
        .build()
    )


def tree_grid(estimator: Estimator) -> list[dict]:
    """A small grid that every tree family takes."""
    builder = ParamGridBuilder()
    for name, values in TREE_GRID.items():
        builder.addGrid(estimator.getParam(name), values)
    return builder.build()


def grid_for(estimator: Estimator) -> list[dict]:
    if isinstance(estimator, LogisticRegression):
        return logistic_grid(estimator)
    return tree_grid(estimator)


@dataclass(frozen=True)
class Tuned:
    """Every fit of a search, and the refitted winner.

    ``scores`` holds (parameters, fold, area, positives, negatives); the counts
    are of the held-out rows that were judged.
    """

    scores: list[tuple[str, int, float, int, int]]
    best_params: dict
    best_model: Model

    def fits(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.scores, "params STRING, fold INT, auc DOUBLE, pos BIGINT, neg BIGINT")

    def table(self, spark: SparkSession) -> DataFrame:
        return (
            self.fits(spark).groupBy("params")
            .agg(F.avg("auc").alias("auc"), F.min("auc").alias("worst_auc"),
                 F.count("*").alias("folds"))
        )


def describe_params(params: dict) -> str:
    return ", ".join(
        f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda i: i[0].name)
    )


def _in_tasks(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.coalesce(tasks) if tasks else rows


def _depth(params: dict) -> int:
    """Levels of a tree at a grid point; zero for other models."""
    return max((v for p, v in params.items() if p.name == "maxDepth"), default=0)


def cross_validate(prepared: DataFrame, estimator: Estimator,
                   grid: Sequence[dict], folds: int = FOLDS,
                   fold: str = "fold", parallelism: int = 4,
                   ledger: str | None = None, tasks: int | None = None,
                   refit_tasks: int | None = None,
                   side_by_side: bool = False) -> Tuned:
    """Fit every grid point on every fold and refit the best on all rows.

    ``prepared`` carries the fold column and is persisted by the caller. The
    rows a fold trains on, and those it leaves out, are held once for all grid
    points and then released, in at most ``tasks`` partitions: a fit starts that many tasks in every step,
    and thousands of short steps cost more to start than to run. Fits of the deepest
    trees come first, since a long one that starts last runs alone. The last refit
    always runs alone, so its rows may lie in more partitions, ``refit_tasks``.
    Every fit that ends is entered in ``ledger``, a folder that all executors
    share; a search that finds its entries there does only what is missing, the
    last refit included. Without one, a new folder is taken.

    ``side_by_side`` fits the logistic regressions of all points and folds in the
    same few steps over the rows (:mod:`classweave.operators.logistic`), judges them
    in one pass and then enters them all.

    Areas are exact and come from the entries, all points and folds in one
    prefix sum. A fold that lacks a class has no area and scores 0.5.
    """
    spark = prepared.sparkSession
    shared_folder(spark)  # boosting checkpoints go there
    book = Ledger.open(
        ledger or new_folder(spark, "ledger"), prepared, estimator, folds, fold)
    names = [describe_params(p) for p in grid]
    label = estimator.getLabelCol()
    missing = [(n, i) for n in range(folds) for i, name in enumerate(names)
               if not book.has(name, n)]
    if side_by_side and missing and logistic.fits_here(estimator, grid):
        missing = _fit_side_by_side(prepared, estimator, grid, missing, fold, names, book)
    # a short grid, or few tasks to a fit, leaves room for folds beside each other
    cores = spark.sparkContext.defaultParallelism
    together = max(1, parallelism // len(grid), -(-cores // tasks) if tasks else 1)
    for first in range(0, folds, together):
        # held rows stay where they are: neighbouring fits are of different folds
        jobs = sorted(((i, n) for n, i in missing if first <= n < first + together),
                      key=lambda job: (-_depth(grid[job[0]]), *job))
        train, held_out = (
            {n: _in_tasks(prepared.filter(rows(n)), tasks).persist(
                StorageLevel.MEMORY_AND_DISK) for n in {n for _, n in jobs}}
            for rows in (lambda n: F.col(fold) != n, lambda n: F.col(fold) == n))

        def fit(n: int, i: int) -> None:
            model = estimator.fit(train[n], grid[i])
            book.write(names[i], n, model_counts([model], held_out[n], label=label))

        try:
            in_parallel(spark, [lambda n=n, i=i: fit(n, i) for i, n in jobs], parallelism)
        finally:
            for rows in (*train.values(), *held_out.values()):
                rows.unpersist()

    entries = [(name, n) for n in range(folds) for name in names]
    judged = areas(book.read(entries), ["params", "fold"], SINGLE_WINDOW_ROWS,
                   F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # one row per grid point and fold
    found = {(r["params"], r["fold"]): (r["auc"], r["pos"], r["neg"])
             for r in judged.collect()}
    scores = []
    for name, n in entries:
        area, pos, neg = found.get((name, n), (None, 0, 0))
        scores.append((name, n, 0.5 if area is None else area, pos, neg))
    mean = dict.fromkeys(names, 0.0)
    for name, _, area, _, _ in scores:
        mean[name] += area / folds
    best = max(range(len(grid)), key=lambda i: (mean[names[i]], -i))
    model = book.winner(names[best])
    if model is None:
        model = estimator.fit(_in_tasks(prepared, refit_tasks or tasks), grid[best])
        book.keep_winner(names[best], model)
    return Tuned(scores, grid[best], model)


def _fit_side_by_side(prepared: DataFrame, estimator: Estimator, grid: Sequence[dict],
                      jobs: Sequence[tuple[int, int]], fold: str, names: Sequence[str],
                      book: Ledger) -> list[tuple[int, int]]:
    """Fit, judge and enter (fold, grid point) in ``jobs``; returns those it leaves.

    All models are judged in one pass over the rows their folds leave out. A fold
    without which a class is missing is left, and so is a table of many columns.
    """
    rows = logistic.Rows(prepared, estimator, fold)
    try:
        done = [(n, i) for n, i in jobs if rows.few_columns and rows.without(n)]
        if done:
            fitted: dict[int, Model] = {}
            rows.fit([(n, grid[i]) for n, i in done], fitted.__setitem__)
            book.write_many([(names[i], n) for n, i in done], rows.counts(
                [(n, fitted[at]) for at, (n, _) in enumerate(done)]))
    finally:
        rows.release()
    return [job for job in jobs if job not in set(done)]


def fold_areas(fitted: Sequence[Model], held_out: DataFrame,
               label: str = "label") -> list[float]:
    """The exact area of several models, in one pass over the rows."""
    counts = materialise(model_counts(fitted, held_out, label=label))
    # one row per model
    found = {r["model"]: r["auc"] for r in areas(counts, ["model"]).collect()}
    return [0.5 if found.get(i) is None else found[i] for i in range(len(fitted))]


def tune_all(prepared: DataFrame, names: Sequence[str] | None = None,
             folds: int = FOLDS, parallelism: int = 4,
             ledger: str | None = None, **params: dict) -> dict[str, Tuned]:
    """The same search for each classifier, each with a grid of its own."""
    tuned = {}
    for name in names or CLASSIFIERS:
        estimator = CLASSIFIERS[name](**params.get(name, {}))
        tuned[name] = cross_validate(
            prepared, estimator, grid_for(estimator), folds,
            parallelism=parallelism, ledger=ledger)
    return tuned
