"""Reading, parsing and writing."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from classweave.operators.profile import preview, schema_table
from classweave.plans import standins as s
from classweave.plans.registry import register
from classweave.session import new_folder
from classweave.sources import records, sinks, tables
from classweave.spec import BAD_RECORD, parse_schema


@register("scan_project", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag
    FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_returnflag = 'R'
""")
def scan_project(spark, sf_dir):
    """Names are found without regard to case, as the first one shows."""
    return (
        s.table(spark, sf_dir, "lineitem")
        .filter(F.col("l_discount").between(0.02, 0.08)
                & (F.col("l_returnflag") == "R"))
        .select(F.col("L_ORDERKEY").alias("l_orderkey"), "l_linenumber",
                "l_quantity", "l_returnflag")
    )


@register("csv_scan", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_scan(spark, sf_dir):
    folder = new_folder(spark, "csv")
    schema = parse_schema(s.CUSTOMER_DDL)
    s.table(spark, sf_dir, "customer").select(*schema.names).write.option(
        "header", True).csv(folder)
    return tables.well_formed(tables.read_csv(spark, folder, schema))


@register("csv_quarantine", """
    SELECT count(*) AS n_rows,
           count(*) FILTER (o_orderstatus = 'P') AS n_quarantined,
           sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END)::BIGINT
               AS good_keys
    FROM orders
""")
def csv_quarantine(spark, sf_dir):
    """Orders in one status carry a price that is not a number."""
    folder = new_folder(spark, "csv")
    schema = parse_schema(s.ORDER_DDL)
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.col("o_totalprice").cast("string"))
    s.table(spark, sf_dir, "orders").withColumn("o_totalprice", price).select(
        *schema.names).write.csv(folder)
    good = F.col(BAD_RECORD).isNull()
    return tables.read_csv(spark, folder, schema, header=False).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~good).alias("n_quarantined"),
        F.sum(F.when(good, F.col("o_orderkey"))).alias("good_keys"),
    )


@register("csv_to_parquet", """
    SELECT c_mktsegment, count(*) AS n,
           sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance
    FROM customer GROUP BY c_mktsegment
""")
def csv_to_parquet(spark, sf_dir):
    source, target = new_folder(spark, "csv"), new_folder(spark, "parquet")
    schema = parse_schema(s.CUSTOMER_DDL)
    s.table(spark, sf_dir, "customer").select(*schema.names).write.option(
        "header", True).csv(source)
    return tables.csv_to_parquet(spark, source, target, schema).groupBy(
        "c_mktsegment").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
            .alias("balance"))


@register("parse_records", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
    FROM orders
""")
def parse_records(spark, sf_dir):
    schema = parse_schema(s.ORDER_DDL)
    text = s.table(spark, sf_dir, "orders").select(
        records.format_line(s.table(spark, sf_dir, "orders"), schema)
        .alias("line"))
    return records.parse_lines(text, "line", schema).select(*schema.names)


@register("json_request_decode", """
    SELECT event_id, event_type, user_id, (props->>'k')::INTEGER AS k
    FROM events
""")
def json_request_decode(spark, sf_dir):
    """Line inside JSON and back, with a quoted JSON field inside the line."""
    schema = parse_schema(
        "event_id BIGINT, event_type STRING, user_id BIGINT, props STRING")
    events = s.table(spark, sf_dir, "events")
    bodies = events.select(
        records.encode_request(records.format_line(events, schema)).alias("body"))
    decoded = bodies.select(records.decode_request(F.col("body")).alias("r"))
    return records.parse_lines(
        decoded.select(F.col("r.data").alias("line")), "line", schema
    ).select("event_id", "event_type", "user_id",
             F.from_json("props", "k INT")["k"].alias("k"))


@register("json_response_encode", """
    SELECT event_id,
           '{"prediction":' || CASE WHEN k > 64 THEN '1.0' ELSE '0.0' END ||
           ',"probability":[' || (1 - k / 128.0)::DOUBLE::VARCHAR || ',' ||
           (k / 128.0)::DOUBLE::VARCHAR || ']}' AS response
    FROM (SELECT event_id, (props->>'k')::INTEGER AS k FROM events)
""")
def json_response_encode(spark, sf_dir):
    p1 = F.from_json("props", "k INT")["k"] / F.lit(128.0)
    return s.table(spark, sf_dir, "events").select(
        "event_id",
        records.encode_response(
            (p1 > 0.5).cast("double"), F.array(1 - p1, p1)).alias("response"))


_LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
    "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@register("schema_table", " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", '{kind}' AS type, TRUE AS nullable, "
    f"count({name}) AS n_values FROM lineitem"
    for name, kind in _LINEITEM_TYPES.items()))
def schema_of_lineitem(spark, sf_dir):
    return schema_table(s.table(spark, sf_dir, "lineitem"))


@register("top_rows", """
    SELECT o_orderkey, o_orderstatus, o_totalprice
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def top_rows(spark, sf_dir):
    return preview(
        s.table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderstatus", "o_totalprice"),
        [F.desc("o_totalprice"), "o_orderkey"])


@register("monitoring_sink", f"""
    SELECT ts::DATE AS day, client_type, count(*) AS n,
           sum(prediction)::DOUBLE AS positive
    FROM ({s.FEED_SQL}) GROUP BY ALL
""")
def monitoring_sink(spark, sf_dir):
    """Append the feed to the day-partitioned table and read it back."""
    path = new_folder(spark, "monitoring")
    feed = s.monitoring_feed(spark, sf_dir)
    sinks.append_monitoring(
        sinks.monitoring_events(feed, "v1", F.col("ts")), path)
    return spark.read.parquet(path).groupBy("day", "client_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("positive"))


@register("fetch_rows", """
    SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL
""")
def fetch_rows(spark, sf_dir):
    """A small result brought to the driver under its bound."""
    counted = s.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(tables.fetch_bounded(counted, 100), counted.schema)


@register("monitoring_clock", """
    SELECT event_type AS client_type, count(*) AS n, true AS in_time, 1::BIGINT AS clocks
    FROM events GROUP BY event_type
""")
def monitoring_clock(spark, sf_dir):
    """Monitoring events carry the time at which their query ran, in UTC."""
    start = datetime.now(timezone.utc)
    events = sinks.monitoring_events(s.monitoring_feed(spark, sf_dir).drop("ts"), "v1")
    first, last = (F.lit(start + timedelta(minutes=m)) for m in (-1, 60))
    return events.groupBy("client_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("ts").between(first, last)).alias("in_time"),
        F.count_distinct("ts").alias("clocks"))
