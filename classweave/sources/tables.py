"""Table readers. Every read declares its schema; none infers one."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.sources.records import parse_line
from classweave.spec import BAD_RECORD


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             header: bool = True) -> DataFrame:
    """Read CSV under ``schema``; a row that does not fit keeps its raw text.

    The text of such a row lands in the ``_bad`` column and its other columns
    hold whatever did parse, so no input row is lost. Lines are parsed whole
    by ``from_csv``: the file reader converts only the columns a query uses,
    and would miss a fault in any other.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if header:
        lines = lines.filter(F.col("value") != _header_line(lines, schema))
    # a generator keeps filters on its columns above it, so a line is parsed once
    return lines.select(F.inline(F.array(parse_line(F.col("value"), schema))))


def _header_line(lines: DataFrame, schema: T.StructType) -> str:
    """The first line, which every file repeats, once its names are checked."""
    first = lines.first()
    if first is None:
        return ""
    names = [n.strip() for n in next(csv.reader([first["value"]]))]
    if names != schema.names:
        raise ValueError(f"header {names} does not match {schema.names}")
    return first["value"]


def well_formed(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BAD_RECORD).isNotNull())


def csv_to_parquet(spark: SparkSession, source: str, target: str,
                   schema: T.StructType) -> DataFrame:
    """Convert once, so that later jobs read columns and skip row groups."""
    read_csv(spark, source, schema).write.parquet(target)
    return read_parquet(spark, target)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, partitions: int,
              **properties: str) -> DataFrame:
    """Read a database table in ranges of a numeric column.

    The ranges are required: without them one task would read the table.
    """
    if partitions < 2 or lower >= upper:
        raise ValueError("give a numeric range and at least two partitions")
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower,
        upperBound=upper, numPartitions=partitions, properties=properties,
    )


def fetch_bounded(df: DataFrame, max_rows: int = 10_000) -> list:
    """Bring a small result to the driver, or fail if it is not small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; aggregate or limit first")
    return rows
