import contextlib
import io
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from classweave.operators import monitor
from classweave.plans import standins
from classweave.streaming import monitoring
import __spark_entry__ as entry_points

QUERIES = entry_points.queries()


def test_truth_that_was_corrected_counts_once(spark):
    events = spark.createDataFrame(
        [("a", 1.0), ("b", 0.0), ("c", 1.0)], "request_id string, prediction double")
    truth = spark.createDataFrame(
        [("a", 0.0, 1), ("a", 1.0, 2), ("b", 1.0, 1)],
        "request_id string, label double, at int")
    joined = monitor.with_truth(events, truth, ts="at")
    assert joined.count() == 3
    row = monitor.success_rate(joined).first()
    assert (row["requests"], row["labelled"], row["success_rate"]) == (3, 2, 0.5)


def test_no_truth_yet(spark):
    events = spark.createDataFrame([("a", 1.0)], "request_id string, prediction double")
    truth = spark.createDataFrame([], "request_id string, label double")
    row = monitor.success_rate(monitor.with_truth(events, truth)).first()
    assert (row["requests"], row["labelled"], row["success_rate"]) == (1, 0, None)


def test_closed_days_are_appended_once(spark, small, tmp_path):
    target, marks = str(tmp_path / "days"), str(tmp_path / "marks")
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet").parquet(small))
    metrics = monitoring.daily_metrics(standins.as_feed(stream), ["client_type"])
    monitoring.append_closed_days(metrics, target, marks).awaitTermination()
    closed = spark.read.parquet(target).select(
        F.to_date("window_start").alias("day"), "client_type", "requests", "positive")
    batch = monitor.requests_over_time(
        standins.monitoring_feed(spark, small), ["client_type"]
    ).select("day", "client_type", "requests", "positive")
    assert closed.count() > 0
    assert closed.exceptAll(batch).count() == 0  # whole days only
    assert batch.count() - closed.count() <= 15


def day_files(target):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in target.glob("day=*/*.parquet")}


def test_only_changed_days_are_rewritten(spark, tmp_path):
    """A new event touches its own day; the day's other groups are carried over."""
    source, target, marks = (tmp_path / n for n in ("in", "days", "marks"))
    ddl = "ts timestamp, client string, prediction double, p1 double"

    def arrive(*rows):
        spark.createDataFrame([(datetime.fromisoformat(t), c, p, 0.5) for t, c, p in rows],
                              ddl).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ddl).parquet(str(source))
        metrics = monitoring.daily_metrics(stream, ["client"], lateness="30 days")
        monitoring.update_changed_days(
            metrics, str(target), str(marks), ["client"]).awaitTermination()
        rows = spark.read.parquet(str(target)).collect()
        return {(str(r["day"]), r["client"]): (r["requests"], r["positive"]) for r in rows}

    found = arrive(("2024-01-01 10:00", "web", 1.0), ("2024-01-01 11:00", None, 0.0),
                   ("2024-01-02 10:00", "web", 0.0))
    assert found == {("2024-01-01", "web"): (1, 1), ("2024-01-01", None): (1, 0),
                     ("2024-01-02", "web"): (1, 0)}
    before = day_files(target)
    found = arrive(("2024-01-01 23:00", None, 1.0), ("2024-01-03 00:00", "app", 0.0))
    assert found == {("2024-01-01", "web"): (1, 1), ("2024-01-01", None): (2, 1),
                     ("2024-01-02", "web"): (1, 0), ("2024-01-03", "app"): (1, 0)}
    after = day_files(target)
    assert after["day=2024-01-02"] == before["day=2024-01-02"]
    assert after["day=2024-01-01"] != before["day=2024-01-01"] and len(after) == 3


def test_a_batch_may_run_twice(spark, tmp_path, monkeypatch):
    """The same figures again change nothing."""
    kept = {}

    class Writer:
        def foreachBatch(self, write):
            kept["write"] = write
            return self

        def __getattr__(self, _):
            return lambda *a, **k: self

    class Metrics:
        writeStream = Writer()

    monitoring.update_changed_days(Metrics(), str(tmp_path / "days"), "", ["client"])
    batch = spark.createDataFrame(
        [(datetime(2024, 1, 1), "a", 3), (datetime(2024, 1, 1), None, 1),
         (datetime(2024, 1, 2), "a", 2)], "window_start timestamp, client string, n long")
    for part in (batch, batch, batch.limit(0), batch.filter("client = 'a'")):
        kept["write"](part, 0)
        got = spark.read.parquet(str(tmp_path / "days")).drop("day")
        assert got.count() == 3 and got.exceptAll(batch).count() == 0


def test_labels_in_time_out_of_time_and_corrected(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("events", "truth", "judged", "marks")}
    start = datetime(2024, 1, 1)
    event_ddl = "request_id string, ts timestamp, prediction double"
    truth_ddl = "request_id string, truth_ts timestamp, label double"

    def run(events, truth):
        for name, rows, ddl in (("events", events, event_ddl), ("truth", truth, truth_ddl)):
            spark.createDataFrame(
                [(i, start + timedelta(days=d), v) for i, d, v in rows], ddl
            ).write.mode("append").parquet(paths[name])
        judged = monitoring.judged_stream(
            spark.readStream.schema(event_ddl).parquet(paths["events"]),
            spark.readStream.schema(truth_ddl).parquet(paths["truth"]))
        monitoring.append_judged(judged, paths["judged"], paths["marks"]).awaitTermination()
        rows = monitoring.last_judgement(spark.read.parquet(paths["judged"])).collect()
        return {r["request_id"]: r["label"] for r in rows if r["request_id"] != "beat"}

    first = run([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 0.0), ("d", 1, 0.0)],
                [("a", 2, 1.0), ("b", 9, 1.0), ("c", 1, 1.0)])
    assert first == {"a": 1.0, "c": 1.0}
    # a correction in time, and beats that end the waits of b and d
    run([("beat", 60, 0.0)], [("c", 5, 0.0), ("beat", 60, 0.0)])
    last = run([("beat", 61, 0.0)], [("beat", 61, 0.0)])
    assert last == {"a": 1.0, "b": None, "c": 0.0, "d": None}


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
PLANNED = [
    "scan_project", "csv_scan", "parse_records", "json_request_decode",
    "describe", "null_audit", "histogram", "kde_grid", "corr_matrix",
    "scatter_bins", "iqr_filter", "iqr_flag", "iqr_multi", "impute_median",
    "string_index", "one_hot_long", "minmax_scale", "feature_vector",
    "chi2_table", "downsample_hash", "balanced_union", "split_hash",
    "fold_assign", "confusion", "auc_exact", "roc_points", "lr_score_fixed",
    "monitor_total", "monitor_by_client", "monitor_daily", "monitor_success",
    "monitor_quality",
]


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_jvm_without_cross_joins(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert not [word for word in FORBIDDEN if word in plan]


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(QUERIES["scan_project"](spark, small))
    assert "GreaterThanOrEqual(l_discount,0.02)" in plan
    assert "EqualTo(l_returnflag,R)" in plan
    read = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "l_quantity" in read and "l_extendedprice" not in read


def test_fences_reach_the_scan(spark, small):
    plan = plan_of(QUERIES["iqr_filter"](spark, small))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value" in plan
