"""Classification metrics as aggregates over a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.functions.running import SINGLE_WINDOW_ROWS, preceding, running_totals
from classweave.session import materialise


def confusion(scored: DataFrame, prediction: str = "prediction",
              label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per group in one aggregate. Unlabelled rows are left out."""
    said, truth = F.col(prediction) == 1, F.col(label) == 1
    return scored.groupBy(*by).agg(
        F.count_if(said & truth).alias("tp"),
        F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"),
        F.count_if(~said & ~truth).alias("tn"),
    )


def share(part: Column, *rest: Column) -> Column:
    """part / (part + rest), zero when there is nothing to divide."""
    whole = part
    for column in rest:
        whole = whole + column
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def rates(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of class one, from confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keep,
        share(tp, fp).alias("precision"),
        share(tp, fn).alias("recall"),
        share(2 * tp, fp, fn).alias("f1"),
    )


def sensitivity_specificity(counts: DataFrame,
                            keep: Sequence[str] = ()) -> DataFrame:
    return counts.select(
        *keep,
        share(F.col("tp"), F.col("fn")).alias("sensitivity"),
        share(F.col("tn"), F.col("fp")).alias("specificity"),
    )


def score_counts(scored: DataFrame, score: str = "score", label: str = "label",
                 by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per group and distinct score, written once."""
    positive = F.col(label) == 1
    return materialise(
        scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("pos"),
             F.count_if(~positive).alias("neg"))
    )


def rank_area() -> Column:
    """Area under the ROC curve by ranks; tied scores earn half credit.

    An aggregate over counts that carry the running ``neg_upto``. Pairs are
    counted in whole numbers, so the area does not depend on how the rows were
    cut. A table with one class only has no area: the result is null.
    """
    def whole(count: Column) -> Column:
        return count.cast("decimal(19,0)")

    half_wins = whole(F.col("pos")) * whole(2 * F.col("neg_upto") - F.col("neg"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.sum(half_wins).cast("double") / F.nullif(2 * pairs, F.lit(0.0))


def areas(counts: DataFrame, by: Sequence[str] = (),
          window_rows: int = SINGLE_WINDOW_ROWS, *also: Column) -> DataFrame:
    """``by``, ``auc`` and ``also``: one exact area for every group at once.

    ``counts`` are ``score_counts``, or have ``score, pos, neg`` like them.
    """
    ranked = running_totals(counts, "score", ["neg"], window_rows, by)
    return ranked.groupBy(*by).agg(rank_area().alias("auc"), *also)


def auc(scored: DataFrame, score: str = "score", label: str = "label",
        window_rows: int = SINGLE_WINDOW_ROWS,
        by: Sequence[str] = ()) -> DataFrame:
    """The area of every group of ``by``, from one pass over the rows."""
    return areas(score_counts(scored, score, label, by), by, window_rows)


def _curve(counts: DataFrame, window_rows: int) -> DataFrame:
    """One point per row of ``counts`` used as the threshold ``score >= t``."""
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    positives, negatives = totals["p"] or 0, totals["n"] or 0
    ranked = running_totals(counts, "score", ["pos", "neg"], window_rows)

    def at_or_above(name: str, total: int) -> Column:
        return F.lit(total) - F.col(f"{name}_upto") + F.col(name)

    def rate(name: str, total: int) -> Column:
        if not total:
            return F.lit(0.0)
        return at_or_above(name, total) / F.lit(total)

    return ranked.withColumns({
        "threshold": F.col("score"),
        "tp": at_or_above("pos", positives).cast("long"),
        "fp": at_or_above("neg", negatives).cast("long"),
        "tpr": rate("pos", positives),
        "fpr": rate("neg", negatives),
    })


ROC_COLUMNS = ["threshold", "tp", "fp", "tpr", "fpr"]


def roc_points(scored: DataFrame, score: str = "score", label: str = "label",
               window_rows: int = SINGLE_WINDOW_ROWS) -> DataFrame:
    """One point per distinct score used as the threshold ``score >= t``."""
    return _curve(score_counts(scored, score, label), window_rows).select(*ROC_COLUMNS)


def roc_corners(scored: DataFrame, score: str = "score", label: str = "label",
                window_rows: int = SINGLE_WINDOW_ROWS) -> DataFrame:
    """The points of :func:`roc_points` where the curve turns, and its end.

    With the origin they draw the same curve and have the same area. A point
    is left out if the steps to it and from it have one direction, which is
    decided in whole numbers.
    """
    counts = materialise(preceding(
        score_counts(scored, score, label), "score", ["pos", "neg"], window_rows))

    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    # the curve goes from high scores to low ones, so its next step is the row before
    straight = whole("pos") * whole("neg_before") == whole("neg") * whole("pos_before")
    return _curve(counts, window_rows).filter(
        F.coalesce(~straight, F.lit(True))).select(*ROC_COLUMNS)


def model_counts(models: Sequence[Model], test: DataFrame,
                 score: str = "rawPrediction",
                 label: str = "label") -> DataFrame:
    """Class counts per (model, distinct score), from one pass over ``test``.

    The rows carry every model's score side by side, so they are prepared and
    read once however many models are judged.
    """
    scored = test.filter(F.col(label).isNotNull())
    for i, model in enumerate(models):
        unused = (model.probabilityCol if score == "rawPrediction"
                  else model.rawPredictionCol)
        scored = model.copy({
            unused: "", getattr(model, f"{score}Col"): f"_s{i}",
            model.predictionCol: f"_y{i}",
        }).transform(scored)
    judged = F.array(*(
        F.struct(
            F.lit(i).alias("model"),
            vector_to_array(F.col(f"_s{i}"))[1].alias("score"),
            (F.col(f"_y{i}") == 1).alias("said"),
        )
        for i in range(len(models))
    ))
    one, said = F.col("one"), F.col("s.said")
    return (
        scored.select((F.col(label) == 1).alias("one"),
                      F.explode(judged).alias("s"))
        .groupBy("s.model", "s.score")
        .agg(F.count_if(one).alias("pos"), F.count_if(~one).alias("neg"),
             F.count_if(one & said).alias("tp"),
             F.count_if(~one & said).alias("fp"))
    )


def compare_models(models: dict[str, Model], test: DataFrame,
                   score: str = "rawPrediction",
                   label: str = "label") -> DataFrame:
    """(model, precision, recall, f1, auc), one row per model.

    ``rawPrediction`` is the score the usual evaluator ranks by;
    ``probability`` ranks by calibrated share.
    """
    counts = materialise(
        model_counts(list(models.values()), test, score, label))
    found = areas(
        counts, ["model"], SINGLE_WINDOW_ROWS,
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        (F.sum("pos") - F.sum("tp")).alias("fn"))
    # one row per model, also for those that judged nothing
    names = counts.sparkSession.createDataFrame(
        list(enumerate(models)), "model INT, name STRING")
    judged = names.join(found, "model", "left").orderBy("model")
    return rates(judged, ["name", "auc"]).select(
        F.col("name").alias("model"), "precision", "recall", "f1", "auc")


def evaluate_model(model: Model, test: DataFrame, name: str = "model",
                   score: str = "rawPrediction",
                   label: str = "label") -> DataFrame:
    return compare_models({name: model}, test, score, label)


def best_model(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.desc("auc"), "model").limit(1)
