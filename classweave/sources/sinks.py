"""Writers for predictions and monitoring events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONITORING_DDL = """
    ts TIMESTAMP, request_id STRING, client_type STRING, input STRING,
    prediction DOUBLE, p1 DOUBLE, model_version STRING
"""
MONITORING_COLUMNS = (
    "ts", "request_id", "client_type", "input", "prediction", "p1",
    "model_version",
)


def monitoring_events(scored: DataFrame, model_version: str,
                      timestamp=None) -> DataFrame:
    """One event per scored request, in the monitoring table's shape."""
    ts = F.current_timestamp() if timestamp is None else timestamp
    return scored.select(
        ts.alias("ts"), "request_id", "client_type", "input", "prediction",
        "p1", F.lit(model_version).alias("model_version"),
    )


def append_monitoring(events: DataFrame, path: str) -> None:
    """Append to the day-partitioned table.

    The rebalance groups rows by day so a day is a few files, and adaptive
    execution splits a day that is too large for one task.
    """
    (
        events.withColumn("day", F.to_date("ts"))
        .hint("rebalance", "day")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def export_predictions(scored: DataFrame, path: str, columns: Sequence[str],
                       file_format: str = "csv") -> None:
    """Write ids, chosen features and ``p1`` as plain columns.

    The number of files follows the input's partitions; nothing is gathered.
    """
    rows = scored.select(*columns, "prediction", "p1")
    writer = rows.write.mode("errorifexists")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}")
