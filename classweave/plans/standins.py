"""The test tables in the roles the operators expect.

``lineitem`` stands in for the employee table, with a planted label;
``events`` for the monitoring feed; ``documents`` and ``labels`` for scored
requests and the truth that arrives for some of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.sources.tables import read_parquet
from classweave.spec import FeatureSpec, parse_schema

LINEITEM_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINEITEM_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

LINES = FeatureSpec(
    numeric=(*LINEITEM_NUMERIC, "l_linenumber", "ship_month", "ship_year"),
    categorical=("l_returnflag", "l_linestatus", "ship_quarter"),
    label="is_large",
    key=LINEITEM_KEY,
)

LINE_DDL = """
    l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
    l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE,
    l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, ship_month INT,
    ship_year INT, ship_quarter STRING, is_large STRING
"""
ORDER_DDL = """
    o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,
    o_totalprice DOUBLE, o_orderpriority STRING
"""
CUSTOMER_DDL = """
    c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
    c_mktsegment STRING
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def planted() -> F.Column:
    return F.col("l_extendedprice") + 300 * F.col("l_quantity") > 95000


PLANTED_SQL = "(l_extendedprice + 300 * l_quantity > 95000)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the planted Yes/No label and three date features."""
    return table(spark, sf_dir, "lineitem").select(
        "*",
        F.month("l_shipdate").alias("ship_month"),
        F.year("l_shipdate").alias("ship_year"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate")).alias("ship_quarter"),
        F.when(planted(), "Yes").otherwise("No").alias("is_large"),
    )


LINES_SQL = f"""
    SELECT *, month(l_shipdate) AS ship_month, year(l_shipdate) AS ship_year,
           'Q' || quarter(l_shipdate) AS ship_quarter,
           CASE WHEN {PLANTED_SQL} THEN 1 ELSE 0 END AS label
    FROM lineitem
"""


def line_schema() -> T.StructType:
    return parse_schema(LINE_DDL)


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its zero discounts made missing."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "l_discount", F.nullif("l_discount", F.lit(0.0)))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem scored by a fixed rule, so that metrics need no training."""
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("score"),
        (F.col("l_quantity") > 30).cast("double").alias("prediction"),
        planted().cast("double").alias("label"),
    )


SCORED_SQL = f"""
    SELECT l_returnflag, l_extendedprice AS score,
           CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS prediction,
           CASE WHEN {PLANTED_SQL} THEN 1 ELSE 0 END AS label
    FROM lineitem
"""


def monitoring_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the monitoring table's shape."""
    return as_feed(table(spark, sf_dir, "events"))


def as_feed(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("string").alias("request_id"),
        F.col("event_type").alias("client_type"),
        F.col("props").alias("input"),
        (F.col("value") > 50).cast("double").alias("prediction"),
        (F.col("value") / 500).alias("p1"),
    )


FEED_SQL = """
    SELECT ts, event_id::VARCHAR AS request_id, event_type AS client_type,
           props AS input, CASE WHEN value > 50 THEN 1 ELSE 0 END AS prediction,
           value / 500 AS p1
    FROM events
"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), "lang", "source",
        (F.col("n_chars") < 1000).cast("double").alias("prediction"),
    )


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"),
        F.col("toxic").cast("double").alias("label"),
    )


JUDGED_SQL = """
    SELECT d.lang, d.source, CASE WHEN n_chars < 1000 THEN 1 ELSE 0 END AS prediction,
           l.toxic AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)
"""
