"""The monitoring questions, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from classweave.operators import monitor
from classweave.plans import standins as s
from classweave.plans.registry import register
from classweave.session import new_folder
from classweave.streaming import monitoring


@register("monitor_total", "SELECT count(*) AS requests FROM events")
def monitor_total(spark, sf_dir):
    return monitor.total_requests(s.monitoring_feed(spark, sf_dir))


@register("monitor_by_client", f"""
    SELECT client_type, count(*) AS requests,
           count(*) FILTER (prediction = 1) AS positive,
           sum(p1::DECIMAL(18,12))::DOUBLE / count(p1) AS mean_p1
    FROM ({s.FEED_SQL}) GROUP BY client_type
""")
def monitor_by_client(spark, sf_dir):
    return monitor.requests_by_client(s.monitoring_feed(spark, sf_dir))


_DAILY_SQL = f"""
    SELECT ts::DATE AS day, client_type, count(*) AS requests,
           count(*) FILTER (prediction = 1) AS positive,
           sum(p1::DECIMAL(18,12))::DOUBLE / count(p1) AS mean_p1
    FROM ({s.FEED_SQL}) GROUP BY ALL
"""


@register("monitor_daily", _DAILY_SQL)
def monitor_daily(spark, sf_dir):
    feed = _utc(spark, s.monitoring_feed)(sf_dir)
    return monitor.requests_over_time(feed, ["client_type"])


def _utc(spark, feed):
    """Day windows are cut in the session's time zone; the tables are in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return lambda sf_dir: feed(spark, sf_dir)


@register("monitor_success", f"""
    SELECT lang, count(*) AS requests, count(label) AS labelled,
           round(count(*) FILTER (prediction = label) / nullif(count(label), 0), 6)
               AS success_rate
    FROM ({s.JUDGED_SQL}) GROUP BY lang
""")
def monitor_success(spark, sf_dir):
    """Truth has arrived for some documents only; the others stay counted."""
    joined = monitor.with_truth(
        s.scored_documents(spark, sf_dir), s.document_truth(spark, sf_dir))
    found = monitor.success_rate(joined, ["lang"])
    return found.withColumn("success_rate", F.round("success_rate", 6))


@register("monitor_quality", f"""
    SELECT source,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity,
           round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity
    FROM (SELECT source, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
                 count(*) FILTER (prediction = 1 AND label = 0) AS fp,
                 count(*) FILTER (prediction = 0 AND label = 1) AS fn,
                 count(*) FILTER (prediction = 0 AND label = 0) AS tn
          FROM ({s.JUDGED_SQL}) WHERE label IS NOT NULL GROUP BY source)
""")
def monitor_quality(spark, sf_dir):
    joined = monitor.with_truth(
        s.scored_documents(spark, sf_dir), s.document_truth(spark, sf_dir))
    found = monitor.quality(joined, ["source"])
    return found.withColumns({
        n: F.round(n, 6) for n in ("precision", "sensitivity", "specificity")})


@register("monitor_daily_stream", _DAILY_SQL)
def monitor_daily_stream(spark, sf_dir):
    """The same table kept by a stream over the events file."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    target, marks = new_folder(spark, "daily"), new_folder(spark, "marks")
    stream = (
        spark.readStream.schema(s.table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    metrics = monitoring.daily_metrics(s.as_feed(stream), ["client_type"])
    monitoring.update_changed_days(
        metrics, target, marks, ["client_type"]).awaitTermination()
    return spark.read.parquet(target).select(
        "day", "client_type", "requests", "positive", "mean_p1")


# labels come up to nine days after their event, some never, some twice
_TRUTH_SQL = f"""
    SELECT request_id, label FROM (
        SELECT event_id::VARCHAR AS request_id, event_id, (value > 40)::INTEGER AS label
        FROM events)
    WHERE event_id % 3 <> 0 AND event_id % 10 <= 7
"""


@register("monitor_success_stream", f"""
    SELECT client_type, count(*) AS requests, count(label) AS labelled,
           round(count(*) FILTER (prediction = label) / nullif(count(label), 0), 6)
               AS success_rate
    FROM ({s.FEED_SQL}) LEFT JOIN ({_TRUTH_SQL}) USING (request_id) GROUP BY client_type
""")
def monitor_success_stream(spark, sf_dir):
    """Success where the truth is a stream of its own, as late as it comes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    paths = {n: new_folder(spark, n) for n in ("events", "truth", "judged", "marks")}
    feed = s.monitoring_feed(spark, sf_dir).select(
        "request_id", "ts", "prediction", "client_type")
    raw = s.table(spark, sf_dir, "events")
    late = raw.filter("event_id % 3 <> 0").select(
        F.col("event_id").cast("string").alias("request_id"),
        (F.col("ts").cast("timestamp")
         + F.make_dt_interval(F.col("event_id") % 10)).alias("truth_ts"),
        (F.col("value") > 40).cast("double").alias("label"))
    # a first label that is wrong, corrected by the one above
    wrong = late.filter("cast(request_id AS bigint) % 10 = 5").select(
        "request_id", (F.col("truth_ts") - F.make_dt_interval(F.lit(1))).alias("truth_ts"),
        (1 - F.col("label")).alias("label"))
    feed.write.parquet(paths["events"])
    late.unionByName(wrong).write.parquet(paths["truth"])
    streams = (spark.readStream.schema(rows.schema).parquet(paths[n])
               for n, rows in (("events", feed), ("truth", late)))
    judged = monitoring.judged_stream(*streams, by=["client_type"])
    monitoring.append_judged(judged, paths["judged"], paths["marks"]).awaitTermination()
    # a quiet feed holds its watermark back: a beat of a later time moves it, and the
    # batch after that, with the next beat, ends the waits
    last = feed.agg(F.max("ts")).first()[0]
    for days in (60, 61):
        beat = spark.range(1).select(
            F.lit("beat").alias("request_id"),
            F.timestamp_add("DAY", F.lit(days), F.lit(last)).alias("ts"))
        beat.select("request_id", "ts", F.lit(0.0).alias("prediction"), F.lit("beat").alias(
            "client_type")).write.mode("append").parquet(paths["events"])
        beat.select("request_id", F.col("ts").alias("truth_ts"), F.lit(0.0).alias("label")
                    ).write.mode("append").parquet(paths["truth"])
        monitoring.append_judged(judged, paths["judged"], paths["marks"]).awaitTermination()
    rows = monitoring.last_judgement(
        spark.read.parquet(paths["judged"]).filter("request_id <> 'beat'"), ["client_type"])
    return monitor.success_rate(rows, ["client_type"]).withColumn(
        "success_rate", F.round("success_rate", 6))
