"""Monitoring metrics kept up to date as events arrive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from classweave.operators.monitor import mean_score
from classweave.session import exists, materialise


def daily_metrics(events: DataFrame, by: Sequence[str] = (),
                  lateness: str = "1 day") -> DataFrame:
    """Requests per day and group; state is dropped once a day is closed.

    ``events.ts`` must be a ``timestamp``: watermarks reject the zoneless type.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("requests"),
             F.count_if(F.col("prediction") == 1).alias("positive"),
             mean_score().alias("mean_p1"))
        .select(F.col("w.start").alias("window_start"), *by, "requests",
                "positive", "mean_p1")
    )


def append_closed_days(metrics: DataFrame, target: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Append each day once, after the watermark has passed it.

    For a stream that goes on. The last days stay open when input ends.
    """
    writer = (
        metrics.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def update_changed_days(metrics: DataFrame, target: str, checkpoint: str,
                        by: Sequence[str] = (),
                        available_now: bool = True) -> StreamingQuery:
    """Keep a table of days, a partition each; only days with new events are rewritten.

    A batch brings the whole figures of every group it changed. They replace
    those groups in their days, whose other groups are carried over; no other
    day is read or written. A batch that runs again after a failure replaces the
    same groups by the same figures. Open days are included, and a day is final
    once the watermark has passed it.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = materialise(batch.withColumn("day", F.to_date("window_start")))
        # one value per day that changed
        days = [r["day"] for r in changed.select("day").distinct().collect()]
        if not days:
            return
        table = changed
        if exists(spark, target):
            keys = ["window_start", *by]
            same = reduce(Column.__and__, (
                F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys))
            kept = (
                spark.read.schema(changed.schema).parquet(target)
                .filter(F.col("day").isin(days)).alias("old")
                .join(changed.alias("new"), same, "left_anti")
            )
            # written first, as the days it reads are replaced
            table = materialise(kept.unionByName(changed))
        table.repartition("day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    writer = (
        metrics.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# --- truth that arrives late ------------------------------------------------

def judged_stream(events: DataFrame, truth: DataFrame, by: Sequence[str] = (),
                  wait: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Each event with the labels that arrive for it within ``wait``.

    ``events`` have ``request_id, ts, prediction`` and ``by``, ``truth`` has
    ``request_id, truth_ts, label``. Both streams carry watermarks, so an event
    is held until no label in time can follow, and a label until no event that it
    could belong to can; state is bounded by ``wait`` and ``lateness``. An event
    whose label does not come in time is given out with a null label when its
    wait is over, in the batch after the one that moved both watermarks past it.
    A corrected label gives a second row; see :func:`last_judgement`.
    """
    held = events.select("request_id", "ts", "prediction", *by).withWatermark(
        "ts", lateness).alias("e")
    labels = truth.select(
        F.col("request_id").alias("truth_of"), "truth_ts", "label"
    ).withWatermark("truth_ts", lateness).alias("t")
    in_time = (
        (F.col("request_id") == F.col("truth_of"))
        & (F.col("truth_ts") >= F.col("ts"))
        & (F.col("truth_ts") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    )
    return held.join(labels, in_time, "left").select(
        "request_id", "ts", "prediction", *by, "label", "truth_ts")


def append_judged(judged: DataFrame, target: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    writer = (
        judged.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def last_judgement(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per request: the label that came last, null where none came."""
    return judged.groupBy("request_id", "ts", "prediction", *by).agg(
        F.max_by("label", "truth_ts").alias("label"))
