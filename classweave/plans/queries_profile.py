"""Exploration and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from classweave.functions.quantiles import quantiles
from classweave.operators import clean, profile
from classweave.plans import standins as s
from classweave.plans.registry import register

_DESCRIBED = ("l_orderkey", *s.LINEITEM_NUMERIC, "l_linenumber")
_DESCRIBED_TEXT = ("l_returnflag", "l_linestatus")


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@register("describe", _union([
    f"""SELECT '{c}' AS "column", count({c}) AS "count",
        round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
        min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max",
        NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text FROM lineitem"""
    for c in _DESCRIBED
] + [
    f"""SELECT '{c}', count({c}), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
        NULL::DOUBLE, min({c}), max({c}) FROM lineitem"""
    for c in _DESCRIBED_TEXT
]))
def describe(spark, sf_dir):
    columns = [*_DESCRIBED, *_DESCRIBED_TEXT]
    found = profile.describe(s.table(spark, sf_dir, "lineitem"), columns)
    return found.withColumns({
        "mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@register("null_audit", _union([
    """SELECT 'l_discount' AS "column", count(*) AS n_rows,
       count(*) FILTER (l_discount = 0) AS n_missing FROM lineitem""",
    "SELECT 'l_tax', count(*), count(*) FILTER (l_tax = 0) FROM lineitem",
    """SELECT 'l_returnflag', count(*), count(*) FILTER (l_returnflag = 'N')
       FROM lineitem""",
    "SELECT 'l_quantity', count(*), 0 FROM lineitem",
]))
def null_audit(spark, sf_dir):
    """Nulls in a number and in text, and NaN in a number."""
    rows = s.gappy_lines(spark, sf_dir).withColumns({
        "l_tax": F.when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_tax")),
        "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
    })
    return profile.null_audit(
        rows, ["l_discount", "l_tax", "l_returnflag", "l_quantity"])


def _histogram_sql(bins: str) -> str:
    return f"""
        WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n,
                          quantile_disc(value, 0.25) AS q1,
                          quantile_disc(value, 0.75) AS q3 FROM events),
        b AS (SELECT *, ({bins})::INTEGER AS bins FROM r),
        w AS (SELECT *, (hi - lo) / bins AS width FROM b),
        c AS (SELECT least(floor((value - lo) / width)::INTEGER, bins - 1) AS bin,
                     count(*) AS n FROM events, w GROUP BY 1)
        SELECT g.bin::BIGINT AS bin, round(w.lo + g.bin * w.width, 6) AS lo,
               round(w.lo + (g.bin + 1) * w.width, 6) AS hi,
               coalesce(c.n, 0) AS n
        FROM w, LATERAL (SELECT unnest(range(w.bins)) AS bin) g
        LEFT JOIN c ON c.bin = g.bin
    """


def _rounded(bins):
    return bins.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@register("histogram", _histogram_sql("20"))
def histogram(spark, sf_dir):
    return _rounded(
        profile.histogram(s.table(spark, sf_dir, "events"), "value", 20))


@register("histogram_auto", _histogram_sql(
    "ceil((hi - lo) / least((hi - lo) / (log2(n) + 1),"
    " 2 * (q3 - q1) / pow(n, 1.0 / 3.0)))"))
def histogram_auto(spark, sf_dir):
    events = s.table(spark, sf_dir, "events")
    bins = profile.automatic_bins(events, "value", relative_error=0)
    return _rounded(profile.histogram(events, "value", bins))


@register("value_counts", """
    SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY l_quantity
""")
def value_counts(spark, sf_dir):
    return profile.value_counts(s.table(spark, sf_dir, "lineitem"), "l_quantity")


_KDE_TAIL = """
    SELECT g.i::INTEGER AS i, round(lo + g.i * (hi - lo) / 99, 6) AS x,
           round(sum(p.n * exp(-0.5 * pow((lo + g.i * (hi - lo) / 99 - centre) / h, 2)))
                 / (max(r.n) * max(h) * sqrt(2 * pi())), 8) AS density
    FROM p, r, (SELECT unnest(range(100)) AS i) g GROUP BY g.i, lo, hi
"""


@register("kde_grid", f"""
    WITH r AS (SELECT *, sd * pow(n, -0.2) AS h FROM (
                 SELECT count(*) AS n, min(value) AS lo, max(value) AS hi,
                        stddev_samp(value) AS sd FROM events)),
    p AS (SELECT least(floor((value - lo) / ((hi - lo) / 1024))::INTEGER, 1023) AS b,
                 count(*) AS n, avg(value) AS centre
          FROM events, (SELECT lo, hi FROM r) GROUP BY 1)
    {_KDE_TAIL}
""")
def kde_grid(spark, sf_dir):
    found = profile.density(s.table(spark, sf_dir, "events"), "value", grid=100)
    return found.select(
        "i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@register("kde_exact", f"""
    WITH r AS (SELECT *, sd * pow(n, -0.2) AS h FROM (
                 SELECT count(*) AS n, min(l_quantity) AS lo,
                        max(l_quantity) AS hi, stddev_samp(l_quantity) AS sd
                 FROM lineitem)),
    p AS (SELECT l_quantity AS centre, count(*) AS n FROM lineitem GROUP BY 1)
    {_KDE_TAIL}
""")
def kde_exact(spark, sf_dir):
    found = profile.density(
        s.table(spark, sf_dir, "lineitem"), "l_quantity", grid=100, bins=None)
    return found.select(
        "i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


_CORRELATED = (*s.LINEITEM_NUMERIC, "l_linenumber")


@register("corr_matrix", _union(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, round(corr({x}, {y}), 6) AS corr "
    "FROM lineitem" for x in _CORRELATED for y in _CORRELATED))
def corr_matrix(spark, sf_dir):
    found = profile.correlation_matrix(
        s.table(spark, sf_dir, "lineitem"), _CORRELATED)
    return found.withColumn("corr", F.round("corr", 6))


# 14 columns, each missing in other rows: null where the number is odd, else NaN
_WIDE = {
    f"w{i:02d}": (f"l_orderkey % 11 = {i % 11}",
                  f"l_quantity * {1 + i % 3} + l_extendedprice / {100 * (i + 1)}"
                  f" + l_linenumber * {i} + l_discount * {7 * i}")
    for i in range(14)
}
_WIDE_SQL = "SELECT " + ", ".join(
    f"CASE WHEN NOT ({gap}) THEN {value} END AS {name}"
    for name, (gap, value) in _WIDE.items()) + " FROM lineitem"


@register("corr_matrix_wide", f"WITH wide AS ({_WIDE_SQL}) " + _union(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, round(corr({x}, {y}), 6) AS corr "
    "FROM wide" for x in _WIDE for y in _WIDE))
def corr_matrix_wide(spark, sf_dir):
    wide = s.table(spark, sf_dir, "lineitem").select(*(
        F.when(F.expr(gap), F.lit(None if int(name[1:]) % 2 else float("nan")))
        .otherwise(F.expr(value)).cast("double").alias(name)
        for name, (gap, value) in _WIDE.items()))
    found = profile.correlation_matrix(wide, list(_WIDE))
    return found.withColumn("corr", F.round("corr", 6))


@register("scatter_bins", """
    WITH r AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
                      min(l_extendedprice) AS yl, max(l_extendedprice) AS yh
               FROM lineitem)
    SELECT least(floor((l_quantity - xl) / ((xh - xl) / 20))::INTEGER, 19) AS bx,
           least(floor((l_extendedprice - yl) / ((yh - yl) / 20))::INTEGER, 19) AS by,
           count(*) AS n
    FROM lineitem, r GROUP BY ALL
""")
def scatter_bins(spark, sf_dir):
    return profile.scatter_bins(
        s.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 20)


def hash_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT"


@register("histogram_far", """
    WITH v AS (SELECT CASE WHEN event_id = (SELECT min(event_id) FROM events)
                           THEN 1e13 ELSE value END AS value FROM events),
    w AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 1e9 AS width
          FROM v),
    c AS (SELECT least(floor((value - lo) / width)::BIGINT, 999999999) AS bin, count(*) AS n
          FROM v, w GROUP BY 1)
    SELECT bin, round(lo + bin * width, 3) AS lo, round(lo + (bin + 1) * width, 3) AS hi, n
    FROM c, w
""")
def histogram_far(spark, sf_dir):
    """One far value and narrow bins: only filled bins are rows."""
    events = s.table(spark, sf_dir, "events")
    first = events.agg(F.min("event_id")).first()[0]
    far = events.withColumn("value", F.when(
        F.col("event_id") == first, 1e13).otherwise(F.col("value")))
    return profile.histogram(far, "value", 10**9).withColumns(
        {n: F.round(n, 3) for n in ("lo", "hi")})


@register("scatter_points", f"""
    SELECT o_custkey, o_totalprice FROM orders
    ORDER BY {hash_sql('o_orderkey::VARCHAR', 7)}, o_orderkey LIMIT 500
""")
def scatter_points(spark, sf_dir):
    """A sample of so many points, however large the table."""
    return profile.scatter_points(
        s.table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 500)


@register("scatter_sample", f"""
    SELECT o_custkey, o_totalprice FROM orders
    WHERE {hash_sql('o_orderkey::VARCHAR', 7)} < 0.1 * 4294967296
""")
def scatter_sample(spark, sf_dir):
    return profile.scatter_sample(
        s.table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice",
        ["o_orderkey"], 0.1)


_PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.99)


@register("quantiles_exact", _union(
    f"SELECT '{c}' AS \"column\", {p} AS p, quantile_disc({c}, {p}) AS value "
    f"FROM {t}"
    for t, c in [*(("lineitem", c) for c in s.LINEITEM_NUMERIC),
                 ("events", "value")]
    for p in _PROBABILITIES).replace(" AS p", "::DOUBLE AS p"))
def quantiles_exact(spark, sf_dir):
    found = {
        **quantiles(s.table(spark, sf_dir, "lineitem"), s.LINEITEM_NUMERIC,
                    _PROBABILITIES, 0),
        **quantiles(s.table(spark, sf_dir, "events"), ["value"],
                    _PROBABILITIES, 0),
    }
    return spark.createDataFrame(
        [(c, p, v) for c, values in found.items()
         for p, v in zip(_PROBABILITIES, values)],
        "column STRING, p DOUBLE, value DOUBLE")


@register("quantiles_sketch", _union(
    f"SELECT {p}::DOUBLE AS p, TRUE AS within_error, count(*) AS n FROM events"
    for p in _PROBABILITIES))
def quantiles_sketch(spark, sf_dir):
    """Each sketched value's true rank must lie within the stated error."""
    events = s.table(spark, sf_dir, "events")
    error = 0.05
    found = quantiles(events, ["value"], _PROBABILITIES, error)["value"]
    n = F.count("value")
    return events.agg(F.array(*(
        F.struct(
            F.lit(p).alias("p"),
            ((F.count_if(F.col("value") <= v) >= F.floor((p - error) * n))
             & (F.count_if(F.col("value") < v) <= F.ceil((p + error) * n)))
            .alias("within_error"),
            n.alias("n"),
        ) for p, v in zip(_PROBABILITIES, found))).alias("a")
    ).select(F.explode("a").alias("s")).select("s.*")


@register("label_counts", f"""
    SELECT label::DOUBLE AS label, count(*) AS n FROM ({s.LINES_SQL}) GROUP BY 1
""")
def label_counts(spark, sf_dir):
    return profile.label_counts(s.LINES.with_label(s.lines(spark, sf_dir)))


@register("class_ratio", f"""
    WITH c AS (SELECT label::DOUBLE AS label, count(*) AS n
               FROM ({s.LINES_SQL}) GROUP BY 1)
    SELECT arg_max(label, n) AS majority_label, max(n) AS majority_count,
           arg_min(label, n) AS minority_label, min(n) AS minority_count,
           round(min(n) / max(n), 6) AS ratio FROM c
""")
def class_ratio(spark, sf_dir):
    found = profile.class_ratio(s.LINES.with_label(s.lines(spark, sf_dir)))
    return found.withColumn("ratio", F.round("ratio", 6))


def _fence_sql(table: str, column: str) -> str:
    return f"""
        f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower,
                     q3 + 1.5 * (q3 - q1) AS upper
              FROM (SELECT quantile_disc({column}, 0.25) AS q1,
                           quantile_disc({column}, 0.75) AS q3 FROM {table}))
    """


@register("iqr_fences", _union(
    f"SELECT '{c}' AS \"column\", q1, q3, "
    "round(lower, 6) AS lower, round(upper, 6) AS upper FROM ("
    f"WITH {_fence_sql('lineitem', c)} SELECT * FROM f)"
    for c in s.LINEITEM_NUMERIC))
def iqr_fences(spark, sf_dir):
    fences = clean.fit_fences(
        s.table(spark, sf_dir, "lineitem"), s.LINEITEM_NUMERIC, 0)
    return fences.table(spark).withColumns({
        "lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@register("iqr_filter", f"""
    WITH {_fence_sql('events', 'value')}
    SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
    FROM events, f WHERE value BETWEEN lower AND upper GROUP BY event_type
""")
def iqr_filter(spark, sf_dir):
    events = s.table(spark, sf_dir, "events")
    return (
        clean.fit_fences(events, ["value"], 0).filter(events)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"),
             F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
             .alias("total"))
    )


@register("iqr_flag", f"""
    WITH {_fence_sql('documents', 'n_chars')}
    SELECT doc_id, n_chars, NOT (n_chars BETWEEN lower AND upper) AS is_outlier
    FROM documents, f
""")
def iqr_flag(spark, sf_dir):
    documents = s.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return clean.fit_fences(documents, ["n_chars"], 0).flag(documents)


@register("iqr_multi", f"""
    WITH d AS (SELECT l_returnflag, nullif(l_discount, 0) AS l_discount,
                      l_quantity, l_extendedprice FROM lineitem),
    f AS (SELECT quantile_disc(l_discount, 0.25) AS d1,
                 quantile_disc(l_discount, 0.75) AS d3,
                 quantile_disc(l_quantity, 0.25) AS q1,
                 quantile_disc(l_quantity, 0.75) AS q3,
                 quantile_disc(l_extendedprice, 0.25) AS e1,
                 quantile_disc(l_extendedprice, 0.75) AS e3 FROM d)
    SELECT l_returnflag, count(*) AS n FROM d, f
    WHERE l_discount BETWEEN d1 - 1.5 * (d3 - d1) AND d3 + 1.5 * (d3 - d1)
      AND l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
      AND l_extendedprice BETWEEN e1 - 1.5 * (e3 - e1) AND e3 + 1.5 * (e3 - e1)
    GROUP BY l_returnflag
""")
def iqr_multi(spark, sf_dir):
    """Fences of several columns together; a missing value drops the row."""
    rows = s.gappy_lines(spark, sf_dir)
    fences = clean.fit_fences(
        rows, ["l_discount", "l_quantity", "l_extendedprice"], 0)
    return fences.filter(rows).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"))


def _impute_sql(fill: str) -> str:
    return f"""
        WITH d AS (SELECT l_returnflag, nullif(l_discount, 0) AS v FROM lineitem),
        m AS ({fill})
        SELECT l_returnflag, count(*) AS n,
               count(*) FILTER (v IS NULL) AS n_filled,
               round(sum(coalesce(v, fill)), 4) AS total
        FROM d, m GROUP BY l_returnflag
    """


def _impute(spark, sf_dir, strategy):
    rows = s.gappy_lines(spark, sf_dir).select("l_returnflag", "l_discount")
    fills = clean.fit_fills(rows, ["l_discount"], strategy, relative_error=0)
    filled = fills.apply(rows.withColumn("v", F.col("l_discount")))
    return filled.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v").isNull()).alias("n_filled"),
        F.round(F.sum("l_discount"), 4).alias("total"))


@register("impute_mean", _impute_sql("SELECT avg(v) AS fill FROM d"))
def impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean")


@register("impute_median", _impute_sql(
    "SELECT quantile_disc(v, 0.5) AS fill FROM d"))
def impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median")


@register("impute_mode", _impute_sql(
    "SELECT v AS fill FROM d WHERE v IS NOT NULL GROUP BY v "
    "ORDER BY count(*) DESC, v LIMIT 1"))
def impute_mode(spark, sf_dir):
    return _impute(spark, sf_dir, "mode")


