"""Batch scoring with a fitted model: one narrow stage, every row kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.sources.records import (
    decode_request,
    encode_response,
    parse_line,
)
from classweave.spec import BAD_RECORD


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def score(df: DataFrame, model: PipelineModel,
          keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``prediction``, ``p1`` and ``is_outlier`` to raw rows.

    Outliers are marked, never dropped, and nothing is learned from the rows
    being scored.
    """
    keep = list(df.columns if keep is None else keep)
    return model.transform(df).select(
        *keep, "is_outlier", "prediction",
        vector_to_array("probability")[1].alias("p1"))


def score_lines(df: DataFrame, line: str, schema: T.StructType,
                model: PipelineModel) -> DataFrame:
    """Score text records. A malformed record keeps its row with null scores.

    Works alike on a static and a streaming frame.
    """
    kept = [c for c in df.columns if c != line]
    parsed = df.select(
        *(F.col(c).alias(f"_in_{c}") for c in kept),
        F.col(line).alias("input"),
        parse_line(F.col(line), schema).alias("_record"),
    ).select(*(f"_in_{c}" for c in kept), "input", "_record.*")
    valid = F.col("input").isNotNull() & F.col(BAD_RECORD).isNull()
    probability = vector_to_array("probability")
    scored = model.transform(parsed).select(
        *(F.col(f"_in_{c}").alias(c) for c in kept),
        "input",
        (~valid).alias("malformed"),
        F.when(valid, F.col("is_outlier")).alias("is_outlier"),
        F.when(valid, F.col("prediction")).alias("prediction"),
        F.when(valid, probability).alias("probability"),
    )
    return scored.withColumn("p1", F.col("probability")[1])


def score_requests(df: DataFrame, body: str, schema: T.StructType,
                   model: PipelineModel) -> DataFrame:
    """JSON request bodies in; request, scores and JSON response out.

    A caller that gives no ``request_id`` gets a generated one.
    """
    decoded = df.select(decode_request(F.col(body)).alias("r")).select(
        F.coalesce("r.request_id", F.expr("uuid()")).alias("request_id"),
        F.col("r.client_type").alias("client_type"),
        F.col("r.data").alias("line"),
    )
    return score_lines(decoded, "line", schema, model).withColumn(
        "response",
        F.when(F.col("prediction").isNotNull(),
               encode_response(F.col("prediction"), F.col("probability"))),
    )


def logistic_score(df: DataFrame, coefficients: dict[str, float],
                   intercept: float) -> DataFrame:
    """Score with known logistic coefficients as one SQL expression."""
    z = F.lit(intercept)
    for column, weight in reversed(coefficients.items()):
        z = F.col(column) * F.lit(weight) + z
    p1 = 1 / (1 + F.exp(-z))
    return df.withColumns({"p1": p1, "prediction": (z > 0).cast("double")})
