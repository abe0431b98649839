"""Scoring a stream of JSON requests with a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from classweave.plans.scoring import score_requests


def request_stream(spark: SparkSession, folder: str,
                   files_per_trigger: int | None = None) -> DataFrame:
    """Text files of one JSON request per line, as they arrive."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def scored_stream(requests: DataFrame, schema: T.StructType,
                  model: PipelineModel, model_version: str) -> DataFrame:
    """Response and monitoring columns of every request in one row."""
    return score_requests(requests, "value", schema, model).select(
        F.current_timestamp().alias("ts"), "request_id", "client_type",
        "input", "malformed", "is_outlier", "prediction", "p1", "response",
        F.lit(model_version).alias("model_version"),
    )


def start_scoring(scored: DataFrame, target: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Append scored requests to Parquet, each exactly once.

    One sink holds responses and monitoring events, so a restart can never
    leave the two apart.
    """
    writer = (
        scored.withColumn("day", F.to_date("ts"))
        .writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .partitionBy("day")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
