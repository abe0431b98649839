"""Encoding, selection, sampling and balancing."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classweave.functions.hashing import fold_number
from classweave.operators import clean, features, oversample, sampling
from classweave.plans import standins as s
from classweave.plans import training
from classweave.plans.queries_profile import hash_sql
from classweave.plans.registry import register
from classweave.spec import FeatureSpec


def _index_sql(column: str, table: str) -> str:
    return f"""
        SELECT '{column}' AS "column", {column} AS category, count(*) AS n,
               (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::DOUBLE
                   AS idx
        FROM {table} GROUP BY {column}
    """


@register("string_index", " UNION ALL ".join(
    _index_sql(c, f"({s.LINES_SQL})") for c in s.LINES.categorical))
def string_index(spark, sf_dir):
    return features.category_index(s.lines(spark, sf_dir), s.LINES.categorical)


@register("string_index_wide", _index_sql("c_name", """
    (SELECT c_name FROM orders JOIN customer ON c_custkey = o_custkey)"""))
def string_index_wide(spark, sf_dir):
    """A column with a category per customer, most of them tied."""
    customers = s.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = s.table(spark, sf_dir, "orders").select("o_custkey")
    named = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return features.category_index(named, ["c_name"])


@register("string_index_fitted", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", idx, n FROM ({_index_sql(c, f'({s.LINES_SQL})')})"""
    for c in s.LINES.categorical))
def string_index_fitted(spark, sf_dir):
    """Rows per index given by the indexers of the model path."""
    indexed = s.lines(spark, sf_dir).select(*s.LINES.categorical)
    learned = features.learn(
        indexed.withColumn("label", F.lit(0.0)), {}, s.LINES.categorical, "label")
    for stage in features.index_stages(learned.categories, "keep"):
        indexed = stage.transform(indexed)
    pairs = F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_index").alias("idx"))
        for c in s.LINES.categorical))
    return (
        indexed.select(F.explode(pairs).alias("p")).select("p.*")
        .groupBy("column", "idx").agg(F.count(F.lit(1)).alias("n")))


@register("label_index", f"""
    SELECT l_orderkey, l_linenumber, label::DOUBLE AS label FROM ({s.LINES_SQL})
""")
def label_index(spark, sf_dir):
    return s.LINES.with_label(s.lines(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "label")


@register("one_hot_long", """
    SELECT l_orderkey, l_linenumber,
           (l_returnflag = 'A')::INTEGER AS l_returnflag_A,
           (l_returnflag = 'N')::INTEGER AS l_returnflag_N,
           (l_linestatus = 'F')::INTEGER AS l_linestatus_F
    FROM lineitem
""")
def one_hot_long(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber",
        *(c.alias(n) for n, c in {
            **features.one_hot_columns(rows, "l_returnflag", ["A", "N", "R"]),
            **features.one_hot_columns(rows, "l_linestatus", ["F", "O"]),
        }.items()))


@register("minmax_scale", """
    SELECT l_orderkey, l_linenumber,
           (l_quantity - min(l_quantity) OVER ()) /
               (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity,
           (l_extendedprice - min(l_extendedprice) OVER ()) /
               (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ())
               AS l_extendedprice,
           0.5::DOUBLE AS constant
    FROM lineitem
""")
def minmax_scale(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(7))
    scaled = features.min_max_columns(
        rows, ["l_quantity", "l_extendedprice", "constant"])
    return rows.select(
        "l_orderkey", "l_linenumber",
        *(c.alias(n) for n, c in scaled.items()))


# columns with a category per part, supplier and flag
WIDE = FeatureSpec(
    numeric=("l_quantity", "l_discount"),
    categorical=("l_partkey", "l_returnflag", "l_suppkey"),
    label="is_large", key=s.LINEITEM_KEY)


def _wide_prep(spark, sf_dir) -> tuple[DataFrame, training.Prep]:
    rows = s.lines(spark, sf_dir)
    return rows, training.fit_prep(rows, WIDE, max_categories=20)


def _ranked_sql(column: str, place: int) -> str:
    return f"""
        SELECT {place} AS place, '{column}' AS "column", {column}::VARCHAR AS category,
               count(*) AS n, sum(label) AS n1,
               row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) - 1 AS idx
        FROM l GROUP BY {column}
    """


_WIDE_SQL = " UNION ALL ".join(
    _ranked_sql(c, i) for i, c in enumerate(WIDE.categorical))


@register("wide_slots", f"""
    WITH l AS ({s.LINES_SQL}), c AS ({_WIDE_SQL}),
    t AS (SELECT count(*)::DOUBLE AS t, sum(label)::DOUBLE AS t1 FROM l),
    x AS (SELECT c.*, pow((n - n1) * t1 - n1 * (t - t1), 2) * t
                      / (n * (t - n) * (t - t1) * t1) AS statistic
          FROM c, t WHERE "column" <> 'l_returnflag')
    SELECT "column" || '=' || category AS slot, n, round(statistic, 6) AS statistic
    FROM x QUALIFY row_number() OVER (ORDER BY round(statistic, 9) DESC, place, idx) <= 10
""")
def wide_slots(spark, sf_dir):
    """The parts and suppliers that the chi-square test picks."""
    _, prep = _wide_prep(spark, sf_dir)
    best = prep.learned.table.best(["l_partkey", "l_suppkey"], features.TOP_SLOTS)
    return spark.createDataFrame(
        [(features.category_slot(r["column"], r["category"]), r["n"], r["statistic"])
         for r in best], "slot STRING, n BIGINT, statistic DOUBLE",
    ).withColumn("statistic", F.round("statistic", 6))


@register("wide_features", f"""
    WITH l AS ({s.LINES_SQL}), c AS ({_WIDE_SQL}),
    o AS (SELECT place, count(*) AS size FROM c GROUP BY place),
    i AS (SELECT c.*, {len(WIDE.numeric)} + idx
                 + coalesce((SELECT sum(size) FROM o WHERE o.place < c.place), 0) AS slot FROM c)
    SELECT l_orderkey, l_linenumber,
           ({len(WIDE.numeric)} + (SELECT sum(size) FROM o))::INTEGER AS size,
           [0, 1, p.slot, f.slot, u.slot]::INTEGER[]::VARCHAR AS slots,
           round((l_quantity - min(l_quantity) OVER ())
                 / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS quantity
    FROM l JOIN i p ON p.place = 0 AND p.category = l_partkey::VARCHAR
           JOIN i f ON f.place = 1 AND f.category = l_returnflag
           JOIN i u ON u.place = 2 AND u.category = l_suppkey::VARCHAR
""")
def wide_features(spark, sf_dir):
    """Every row's sparse vector, with a slot for every part and supplier."""
    rows, prep = _wide_prep(spark, sf_dir)
    made = training.all_features(rows, prep, ["l_orderkey", "l_linenumber"])
    parts = F.unwrap_udt("features")
    return made.select(
        "l_orderkey", "l_linenumber", parts["size"].alias("size"),
        F.concat(F.lit("["), F.array_join(parts["indices"], ", "), F.lit("]")).alias("slots"),
        F.round(parts["values"][0], 6).alias("quantity"))


def _slot_sql() -> str:
    scaled = [
        f"""SELECT '{c}_scaled' AS slot, round(sum(({c} - lo) / (hi - lo)), 4)
            AS total FROM d, (SELECT min({c}) AS lo, max({c}) AS hi FROM d)"""
        for c in s.LINES.numeric
    ]
    hot = [
        f"SELECT '{c}=' || {c}, count(*)::DOUBLE FROM d GROUP BY {c}"
        for c in s.LINES.categorical
    ]
    return f"WITH d AS ({s.LINES_SQL}) " + " UNION ALL ".join(scaled + hot)


@register("feature_vector", _slot_sql())
def feature_vector(spark, sf_dir):
    """Column sums of the assembled vector, slot by slot."""
    rows = s.lines(spark, sf_dir).select(*s.LINES.inputs)
    numeric = s.LINES.numeric
    typed = features.clean_stage(
        clean.Fills({c: 0.0 for c in numeric}), clean.Fences(())
    ).transform(rows.withColumn("label", F.lit(0.0)))
    learned = features.learn(
        typed, {c: [] for c in numeric}, s.LINES.categorical, "label")
    fitted = features.feature_stages(typed, learned)
    slots = F.array(*(F.lit(n) for n in fitted.slots))
    return (
        fitted.transform(typed)
        .select(F.posexplode(vector_to_array("features")).alias("i", "v"))
        .groupBy("i").agg(F.round(F.sum("v"), 4).alias("total"))
        .select(F.get(slots, F.col("i")).alias("slot"), "total"))


def _chi_sql(feature: str, label: str, table: str) -> str:
    return f"""
        SELECT '{feature}' AS feature,
               round(max(t) * (sum(o * o / (r * c)) - 1), 6) AS statistic,
               (count(DISTINCT v) - 1) * (count(DISTINCT y) - 1) AS dof
        FROM (SELECT *, sum(o) OVER (PARTITION BY v) AS r,
                     sum(o) OVER (PARTITION BY y) AS c, sum(o) OVER () AS t
              FROM (SELECT {feature} AS v, {label} AS y, count(*)::DOUBLE AS o
                    FROM {table} GROUP BY ALL))
    """


_CHI_FEATURES = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity",
                 "ship_quarter")
_CHI_SQL = " UNION ALL ".join(
    _chi_sql(c, "label", f"({s.LINES_SQL})") for c in _CHI_FEATURES)


@register("chi2_table", _CHI_SQL)
def chi2_table(spark, sf_dir):
    rows = s.LINES.with_label(s.lines(spark, sf_dir))
    return features.chi_square_table(rows, _CHI_FEATURES, "label").withColumn(
        "statistic", F.round("statistic", 6))


@register("chi2_events", _chi_sql(
    "event_type", "big", "(SELECT *, value > 50 AS big FROM events)"))
def chi2_events(spark, sf_dir):
    events = s.table(spark, sf_dir, "events").withColumn(
        "big", F.col("value") > 50)
    return features.chi_square_table(events, ["event_type"], "big").withColumn(
        "statistic", F.round("statistic", 6))


@register("chi2_tests", _CHI_SQL)
def chi2_tests(spark, sf_dir):
    """The same numbers from the test the selector ranks slots by."""
    rows = s.LINES.with_label(s.lines(spark, sf_dir))
    codes = {
        c: (F.ascii(c).cast("double") if c in ("l_returnflag", "l_linestatus")
            else F.substring(c, 2, 1).cast("double") if c == "ship_quarter"
            else F.col(c).cast("double"))
        for c in _CHI_FEATURES
    }
    vectors = features.VectorAssembler(
        inputCols=list(codes), outputCol="v"
    ).transform(rows.select("label", *(e.alias(c) for c, e in codes.items())))
    names = F.array(*(F.lit(c) for c in codes))
    return features.chi_square_tests(vectors, "v", "label").select(
        F.get(names, F.col("featureIndex")).alias("feature"),
        F.round("statistic", 6).alias("statistic"),
        F.col("degreesOfFreedom").cast("long").alias("dof"))


@register("chi2_select")
def chi2_select(spark, sf_dir):
    """The ten slots the training path keeps, by name."""
    from classweave.plans.training import fit_prep

    prep = fit_prep(s.lines(spark, sf_dir), s.LINES)
    return spark.createDataFrame(
        list(zip(prep.selected, prep.selected_slots)), "idx INT, slot STRING")


@register("downsample_hash", f"""
    WITH c AS (SELECT count(*) FILTER (o_totalprice > 400000) AS m,
                      count(*) FILTER (o_totalprice <= 400000) AS j FROM orders)
    SELECT o_orderkey, (o_totalprice > 400000)::INTEGER::DOUBLE AS label
    FROM orders, c
    WHERE o_totalprice > 400000
       OR {hash_sql('o_orderkey::VARCHAR', 42)} < m / j * 4294967296
""")
def downsample_hash(spark, sf_dir):
    rows = _labelled_orders(spark, sf_dir)
    return sampling.balance_classes(rows, ["o_orderkey"])


def _labelled_orders(spark, sf_dir):
    return s.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") > 400000).cast("double").alias("label"))


_LINE_KEY = " || ':' || ".join(f"{c}::VARCHAR" for c in s.LINEITEM_KEY)


@register("balanced_union", f"""
    WITH d AS ({s.LINES_SQL}),
    c AS (SELECT count(*) FILTER (label = 1) AS m,
                 count(*) FILTER (label = 0) AS j FROM d)
    SELECT label::DOUBLE AS label, l_returnflag, count(*) AS n,
           sum(l_orderkey)::BIGINT AS keys
    FROM d, c
    WHERE label = 1 OR {hash_sql(_LINE_KEY, 42)} < m / j * 4294967296
    GROUP BY ALL
""")
def balanced_union(spark, sf_dir):
    rows = s.LINES.with_label(s.lines(spark, sf_dir)).select(
        *s.LINEITEM_KEY, "l_returnflag", "label")
    balanced, _, _ = sampling.balanced_union(rows, s.LINEITEM_KEY)
    return balanced.groupBy("label", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@register("split_hash", f"""
    SELECT o_orderkey, CASE WHEN {hash_sql('o_orderkey::VARCHAR', 43)}
                            < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS part
    FROM orders
""")
def split_hash(spark, sf_dir):
    train, test = sampling.split(
        s.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")))


@register("fold_assign", f"""
    SELECT o_orderkey, ({hash_sql('o_orderkey::VARCHAR', 44)} % 5)::INTEGER AS fold
    FROM orders
""")
def fold_assign(spark, sf_dir):
    return s.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fold_number(["o_orderkey"], sampling.FOLD_SEED, 5).alias("fold"))


def _synthetic_orders(spark, sf_dir):
    rows = s.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        array_to_vector(F.array(
            F.col("o_totalprice") / 500000, F.col("o_custkey") / F.lit(1e5),
            F.month("o_orderdate") / F.lit(12.0))).alias("features"),
        (F.col("o_totalprice") > 400000).cast("double").alias("label"))
    balance = sampling.measure_balance(rows)
    return rows, oversample.synthetic_minority(
        rows, balance, "o_orderkey", size=3)


@register("smote_counts", f"""
    WITH c AS (SELECT *, j / m - 1 - floor(j / m - 1) AS part, floor(j / m - 1) AS whole
               FROM (SELECT count(*) FILTER (o_totalprice > 400000) AS m,
                            count(*) FILTER (o_totalprice <= 400000) AS j FROM orders))
    SELECT label, sum(n)::BIGINT AS n FROM (
        SELECT (o_totalprice > 400000)::INTEGER::DOUBLE AS label,
               CASE WHEN o_totalprice <= 400000 THEN 1
                    WHEN {hash_sql('o_orderkey::VARCHAR', 42)} < part * 4294967296
                    THEN 2 + whole ELSE 1 + whole END AS n
        FROM orders, c)
    GROUP BY label
""")
def smote_counts(spark, sf_dir):
    """Class sizes once the synthetic rows have joined the real ones."""
    rows, synthetic = _synthetic_orders(spark, sf_dir)
    return rows.select("label").unionByName(synthetic.select("label")).groupBy(
        "label").agg(F.count(F.lit(1)).alias("n"))


_SMOTE_SQL = f"""
    WITH o AS (SELECT o_orderkey AS id, o_totalprice > 400000 AS minority,
                      o_totalprice / 500000 AS a, o_custkey / 1e5 AS b,
                      month(o_orderdate) / 12.0::DOUBLE AS c FROM orders),
    m AS (SELECT * FROM o WHERE minority),
    t AS (SELECT count(*) FILTER (NOT minority)::DOUBLE / count(*) FILTER (minority) - 1 AS w
          FROM o),
    near AS (
        SELECT p.id, q.a, q.b, q.c, row_number() OVER (PARTITION BY p.id ORDER BY
                   (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)
                   + (p.c - q.c) * (p.c - q.c), q.id) - 1 AS place
        FROM m p JOIN m q ON p.id <> q.id QUALIFY place < 5),
    copies AS (
        SELECT m.*, unnest(generate_series(1, floor(w)::BIGINT + CASE WHEN
                   {hash_sql('id::VARCHAR', 42)} < (w - floor(w)) * 4294967296
                   THEN 1 ELSE 0 END)) AS copy
        FROM m, t),
    made AS (
        SELECT *, {hash_sql("(id || ':' || copy)", 42)}
                  % least(5, (SELECT count(*) - 1 FROM m)) AS pick,
               {hash_sql("(copy || ':' || id)", 43)} / 4294967296::DOUBLE AS way
        FROM copies)
    SELECT d.id AS parent, copy::INTEGER AS copy, round(d.a + way * (n.a - d.a), 9) AS x0,
           round(d.b + way * (n.b - d.b), 9) AS x1, round(d.c + way * (n.c - d.c), 9) AS x2,
           1::DOUBLE AS label
    FROM made d JOIN near n ON n.id = d.id AND n.place = d.pick
"""


@register("smote_rows", _SMOTE_SQL)
def smote_rows(spark, sf_dir):
    """Every synthetic row, between its parent and one of its true neighbours."""
    _, synthetic = _synthetic_orders(spark, sf_dir)
    x = vector_to_array("features")
    return synthetic.select(
        "parent", "copy", *(F.round(x[i], 9).alias(f"x{i}") for i in range(3)), "label")

