"""Questions asked of the monitoring table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.operators.evaluate import confusion, share


def total_requests(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("requests"))


def mean_score(p1: str = "p1") -> Column:
    """Mean probability through an exact sum.

    A sum of doubles depends on the order of the rows; a decimal one does not,
    so a figure stays the same however often and wherever it is computed.
    """
    total = F.sum(F.col(p1).cast("decimal(18,12)")).cast("double")
    return total / F.nullif(F.count(p1), F.lit(0))


def requests_by_client(events: DataFrame) -> DataFrame:
    return events.groupBy("client_type").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("prediction") == 1).alias("positive"),
        mean_score().alias("mean_p1"),
    )


def day_of(ts: str = "ts") -> Column:
    return F.window(F.col(ts), "1 day")["start"].cast("date")


def requests_over_time(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tumbling one-day windows."""
    return events.groupBy(day_of().alias("day"), *by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("prediction") == 1).alias("positive"),
        mean_score().alias("mean_p1"),
    )


def latest_truth(truth: DataFrame, key: str = "request_id",
                 label: str = "label", ts: str | None = None) -> DataFrame:
    """One label per request, the latest by ``ts`` if it was corrected.

    Without ``ts`` a request with two different labels is an error, as nothing
    tells which came last. Reducing the truth first keeps the join from
    multiplying events.
    """
    if ts:
        chosen = F.max_by(label, ts)
    else:
        chosen = F.when(F.min(label) != F.max(label), F.raise_error(F.lit(
            "a request has different labels: name their time column"))
        ).otherwise(F.max(label))
    return truth.groupBy(key).agg(chosen.alias(label))


def with_truth(events: DataFrame, truth: DataFrame,
               key: str = "request_id", label: str = "label",
               ts: str | None = None) -> DataFrame:
    """Events with the label where it has arrived, null where it has not."""
    return events.join(latest_truth(truth, key, label, ts), key, "left")


def success_rate(joined: DataFrame, by: Sequence[str] = (),
                 label: str = "label") -> DataFrame:
    """Share of labelled requests whose prediction was right."""
    right = F.count_if(F.col("prediction") == F.col(label))
    known = F.count(F.col(label))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        known.alias("labelled"),
        (right / F.nullif(known, F.lit(0))).alias("success_rate"),
    )


def quality(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, sensitivity and specificity per group."""
    counts = confusion(joined.filter(F.col("label").isNotNull()), by=by)
    return rates_and_specificity(counts, by)


def rates_and_specificity(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.select(
        *by,
        share(F.col("tp"), F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("fn")).alias("sensitivity"),
        share(F.col("tn"), F.col("fp")).alias("specificity"),
    )
