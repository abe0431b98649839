"""Text and JSON records held in string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.spec import BAD_RECORD

# ``data`` is required of a caller; the other two are optional.
REQUEST_DDL = "data STRING, request_id STRING, client_type STRING"


def _ddl(schema: T.StructType) -> str:
    fields = [*schema.fields, T.StructField(BAD_RECORD, T.StringType())]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def parse_line(line: Column, schema: T.StructType) -> Column:
    """One comma-separated line as a struct of typed fields plus ``_bad``.

    Quotes, negatives and decimals follow CSV rules. A line of the wrong width
    or with a field of the wrong type sets ``_bad`` to the line's text.
    """
    return F.from_csv(
        line, _ddl(schema),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD},
    )


def parse_lines(df: DataFrame, line: str, schema: T.StructType) -> DataFrame:
    """Replace the text column by its fields, keeping every row."""
    kept = [c for c in df.columns if c != line]
    return (
        df.withColumn("_record", parse_line(F.col(line), schema))
        .select(*kept, F.col(line), "_record.*")
    )


def format_line(df: DataFrame, schema: T.StructType) -> Column:
    """Inverse of :func:`parse_line` for the columns of ``schema``."""
    return F.to_csv(F.struct(*(F.col(f.name) for f in schema.fields)))


def decode_request(body: Column) -> Column:
    """``{"data": "<line>"}`` as a struct; every field null if it is not JSON."""
    return F.from_json(body, REQUEST_DDL)


def encode_request(line: Column, **extra: Column) -> Column:
    fields = [line.alias("data"), *(c.alias(n) for n, c in extra.items())]
    return F.to_json(F.struct(*fields))


def encode_response(prediction: Column, probability: Column) -> Column:
    """``{"prediction": p, "probability": [p0, p1]}``; an array, not a vector."""
    return F.to_json(
        F.struct(
            prediction.alias("prediction"), probability.alias("probability")
        )
    )
