import datetime
import json

import pytest
from pyspark.sql import functions as F

from classweave.sources import records, sinks, tables
from classweave.spec import BAD_RECORD, EMPLOYEE, employee_schema, parse_schema
from employees import employees

SCHEMA = parse_schema("id INT, name STRING, amount INT")


def parse(spark, *lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return records.parse_lines(df, "line", SCHEMA).collect()


def test_text_records(spark):
    quoted, negative, decimal, short, long = parse(
        spark, '1,"a, b",7', "2,x,-5", "3,x,3.5", "4,x", "5,x,1,9")
    assert (quoted["name"], quoted["amount"], quoted[BAD_RECORD]) == ("a, b", 7, None)
    assert (negative["amount"], negative[BAD_RECORD]) == (-5, None)
    assert (decimal["id"], decimal["amount"], decimal[BAD_RECORD]) == (3, None, "3,x,3.5")
    assert short[BAD_RECORD] == "4,x"
    assert long[BAD_RECORD] == "5,x,1,9"


def test_line_round_trip(spark):
    df = spark.createDataFrame([(1, 'say "hi", ok', -3), (2, None, None)], SCHEMA)
    lines = df.select(records.format_line(df, SCHEMA).alias("line"))
    back = records.parse_lines(lines, "line", SCHEMA)
    assert back.select(*SCHEMA.names).collect() == df.collect()


def test_csv_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name,amount\n1,a,5\n")
    good = tables.well_formed(tables.read_csv(spark, str(tmp_path), SCHEMA))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") == 1


def test_csv_keeps_bad_rows(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.csv").write_text(
            f"id,name,amount\n{n},a,5\n\n{n}0,b,oops\n{n}00,c\n")
    df = tables.read_csv(spark, str(tmp_path), SCHEMA)
    assert df.count() == 6
    assert sorted(r["id"] for r in tables.well_formed(df).collect()) == [1, 2]
    assert {r[BAD_RECORD] for r in tables.quarantined(df).collect()} == {
        "10,b,oops", "100,c", "20,b,oops", "200,c"}
    # a fault shows even when its column is not asked for
    assert df.select("id", BAD_RECORD).filter(F.col(BAD_RECORD).isNotNull()).count() == 4


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,nom,amount\n1,a,5\n")
    with pytest.raises(ValueError, match="does not match"):
        tables.read_csv(spark, str(tmp_path), SCHEMA)


def test_employee_schema():
    schema = employee_schema()
    assert len(schema) == 35
    assert len(EMPLOYEE.numeric) == 23 and len(EMPLOYEE.categorical) == 7
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert all(kinds[c] == "int" for c in EMPLOYEE.numeric)
    assert all(kinds[c] == "string" for c in EMPLOYEE.categorical)


def test_employee_csv_round_trip(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = employees(spark, 60)
    rows.write.option("header", True).csv(source)
    back = tables.csv_to_parquet(spark, source, target, employee_schema())
    assert back.filter(F.col(BAD_RECORD).isNotNull()).count() == 0
    assert back.drop(BAD_RECORD).exceptAll(rows).count() == 0


def test_requests_and_responses(spark):
    df = spark.createDataFrame(
        [('{"data": "1,a,2", "client_type": "web"}',), ("not json",)], "body string")
    good, bad = df.select(records.decode_request(F.col("body")).alias("r")).collect()
    assert good["r"]["data"] == "1,a,2" and good["r"]["client_type"] == "web"
    assert bad["r"]["data"] is None
    response = spark.range(1).select(records.encode_response(
        F.lit(1.0), F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    assert json.loads(response) == {"prediction": 1.0, "probability": [0.25, 0.75]}


def test_monitoring_table_is_split_by_day(spark, tmp_path):
    path = str(tmp_path / "m")
    scored = spark.createDataFrame(
        [("a", "web", "x", 1.0, 0.9)],
        "request_id string, client_type string, input string, prediction double, p1 double")
    for day in (1, 2):
        ts = F.lit(datetime.datetime(2024, 1, day, 12)).cast("timestamp")
        sinks.append_monitoring(sinks.monitoring_events(scored, "v1", ts), path)
    back = spark.read.parquet(path)
    assert back.count() == 2
    assert {str(r["day"]) for r in back.collect()} == {"2024-01-01", "2024-01-02"}
    assert set(sinks.MONITORING_COLUMNS) < set(back.columns)


def test_export_formats(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.0, 0.2)], "id int, prediction double, p1 double")
    sinks.export_predictions(scored, str(tmp_path / "c"), ["id"])
    sinks.export_predictions(scored, str(tmp_path / "p"), ["id"], "parquet")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {
        "id": "1", "prediction": "0.0", "p1": "0.2"}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        sinks.export_predictions(scored, str(tmp_path / "z"), ["id"], "xml")


def test_bounded_fetch(spark):
    assert len(tables.fetch_bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        tables.fetch_bounded(spark.range(6), 5)


def test_jdbc_needs_ranges(spark):
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:x", "t", "id", 0, 10, 1)
