"""Encoding, scaling, assembly and chi-square selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Transformer
from pyspark.ml.feature import (
    MinMaxScaler,
    MinMaxScalerModel,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.functions.chi import chi_square, log_p_value
from classweave.functions.quantiles import finite
from classweave.functions.running import global_rank
from classweave.operators.categories import CategoryTable, category_table
from classweave.operators.clean import Fences, Fills, sql_name
from classweave.session import materialise

# How many vector slots the selector keeps.
TOP_SLOTS = 10

# a column with more categories is kept as a table, not in the model's stages
MAX_CATEGORIES = 10_000


# --- encoders as tables -----------------------------------------------------

def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, n, idx): most frequent first, ties by name.

    Rows shrink to one per category, and a distributed sort ranks those, so a
    column of mostly distinct values is indexed as well as a short list.
    """
    pairs = F.array(*(
        F.struct(F.lit(c).alias("column"),
                 F.col(c).cast("string").alias("category"))
        for c in columns
    ))
    counts = (
        df.select(F.explode(pairs).alias("s")).select("s.*")
        .filter(F.col("category").isNotNull())
        .groupBy("column", "category").agg(F.count("*").alias("n"))
    )
    ranked = global_rank(counts, ["column", F.desc("n"), "category"])
    starts = ranked.groupBy("column").agg(F.min("rank").alias("start"))
    # one row per indexed column
    return ranked.join(F.broadcast(starts), "column").select(
        "column", "category", "n",
        (F.col("rank") - F.col("start")).cast("double").alias("idx"))


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str],
                    drop_last: bool = True) -> dict[str, Column]:
    """One 0/1 column per category, the last left out as the baseline."""
    kept = list(categories)[:-1] if drop_last else list(categories)
    return {
        f"{column}_{c}": (F.col(column) == c).cast("int") for c in kept
    }


def learn_range(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    row = df.agg(*(
        f(finite(df, c)).alias(f"{n}_{c}")
        for c in columns for n, f in (("lo", F.min), ("hi", F.max))
    )).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def min_max_columns(df: DataFrame, columns: Sequence[str],
                    ranges: dict[str, tuple] | None = None) -> dict[str, Column]:
    """Each column scaled to [0, 1]; a constant column becomes 0.5."""
    ranges = ranges or learn_range(df, columns)
    scaled = {}
    for c in columns:
        low, high = ranges[c]
        if low == high:
            scaled[c] = F.lit(0.5)
        else:
            scaled[c] = (F.col(c) - F.lit(low)) / F.lit(high - low)
    return scaled


# --- encoders as fitted stages ----------------------------------------------

def numeric_name(column: str) -> str:
    return f"{column}_num"


def clean_stage(fills: Fills, fences: Fences,
                flag: str = "is_outlier") -> SQLTransformer:
    """Typed, filled numerics and the outlier flag, in one projection.

    Fences read the raw columns, so a missing value is flagged even though
    its fill lets the row be scored.
    """
    numerics = ", ".join(
        f"{fills.sql(c)} AS {sql_name(numeric_name(c))}" for c in fills.values
    )
    return SQLTransformer(statement=(
        f"SELECT *, {numerics}, NOT coalesce({fences.sql()}, FALSE) "
        f"AS {sql_name(flag)} FROM __THIS__"
    ))


@dataclass(frozen=True)
class SlotTest:
    slot: str
    statistic: float
    dof: int
    log_p: float


@dataclass(frozen=True)
class Learned:
    """All that encoding, scaling and selection need to know of the rows."""

    ranges: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]
    tests: dict[str, SlotTest]
    class_counts: tuple[int, int]
    # all categories, and the best of the columns that have too many to list
    table: CategoryTable | None = None
    best: dict[str, list[str]] = field(default_factory=dict)


def bin_by_cuts(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts the value reaches."""
    number = F.lit(0)
    for cut in cuts:
        number = number + (value >= F.lit(cut)).cast("int")
    return number


def feature_cells(df: DataFrame, cuts: dict[str, Sequence[float]],
                  categorical: Sequence[str], label: str) -> DataFrame:
    """Class counts and value range per (feature, bin or category).

    One scan. Every task reduces its rows to one entry per cell before the
    shuffle, so a category held by most rows costs no more than a rare one.
    """
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            bin_by_cuts(F.col(numeric_name(c)), inner).alias("bin"),
            F.lit(None).cast("string").alias("category"),
            F.col(numeric_name(c)).alias("value"),
        )
        for c, inner in cuts.items()
    ] + [
        F.struct(
            F.lit(c).alias("feature"), F.lit(0).alias("bin"),
            F.col(c).cast("string").alias("category"),
            F.lit(None).cast("double").alias("value"),
        )
        for c in categorical
    ]
    return (
        df.select((F.col(label) == 1).alias("one"),
                  F.explode(F.array(*parts)).alias("s"))
        .select("one", "s.*")
        .groupBy("feature", "bin", "category")
        .agg(F.count_if(~F.col("one")).alias("n0"),
             F.count_if("one").alias("n1"),
             F.min("value").alias("low"), F.max("value").alias("high"))
    )


def learn(df: DataFrame, cuts: dict[str, Sequence[float]],
          categorical: Sequence[str], label: str,
          max_categories: int = MAX_CATEGORIES, top: int = TOP_SLOTS) -> Learned:
    """Ranges, category order and slot tests from one grouped scan.

    The cells are written first and counted. Categories of a column that has
    more than ``max_categories`` stay in a written table; the driver gets only
    the ``top`` best of them, which are all a selection of ``top`` can need.
    """
    cells = materialise(feature_cells(df, cuts, categorical, label))
    sizes = cells.groupBy("feature").agg(
        F.count("*").alias("cells"), F.sum("n0").alias("n0"),
        F.sum("n1").alias("n1")).collect()  # one row per feature
    if not sizes:
        raise ValueError("no labelled row lies inside the fences")
    classes = sizes[0]["n0"], sizes[0]["n1"]
    count = {r["feature"]: r["cells"] for r in sizes}
    wide = [c for c in categorical if count[c] > max_categories]
    by_feature: dict[str, list] = {}
    for row in cells.filter(~F.col("feature").isin(wide)).collect():
        by_feature.setdefault(row["feature"], []).append(row)
    narrow = [c for c in categorical if c not in wide]
    learned = _digest(by_feature, cuts, narrow, classes)
    if not wide:
        return learned
    table = category_table(cells, categorical, classes)
    best: dict[str, list[str]] = {c: [] for c in wide}
    for r in sorted(table.best(wide, top), key=lambda r: r["idx"]):
        best[r["column"]].append(r["category"])
        _add_test(learned.tests, category_slot(r["column"], r["category"]),
                  _in_and_out(r, classes))
    return replace(learned, table=table, best=best)


def _add_test(tests: dict[str, SlotTest], slot: str,
              cells: list[tuple[int, int]]) -> None:
    statistic, dof = chi_square(cells)
    tests[slot] = SlotTest(slot, statistic, dof, log_p_value(statistic, dof))


def _in_and_out(row, classes: tuple[int, int]) -> list[tuple[int, int]]:
    """Class counts with a category and without it."""
    return [(row["n0"], row["n1"]), (classes[0] - row["n0"], classes[1] - row["n1"])]


def _digest(by_feature: dict[str, list], cuts: dict[str, Sequence[float]],
            categorical: Sequence[str], classes: tuple[int, int]) -> Learned:
    ranges, categories, tests = {}, {}, {}
    for c in cuts:
        rows = by_feature[c]
        ranges[c] = (min(r["low"] for r in rows), max(r["high"] for r in rows))
        _add_test(tests, numeric_slot(c), [(r["n0"], r["n1"]) for r in rows])
    for c in categorical:
        known = [r for r in by_feature[c] if r["category"] is not None]
        known.sort(key=lambda r: (-(r["n0"] + r["n1"]), r["category"]))
        categories[c] = [r["category"] for r in known]
        for r in known:
            _add_test(tests, category_slot(c, r["category"]), _in_and_out(r, classes))
    return Learned(ranges, categories, tests, classes)


def numeric_slot(column: str) -> str:
    return f"{column}_scaled"


def category_slot(column: str, category: str) -> str:
    return f"{column}={category}"


@dataclass(frozen=True)
class FeatureStages:
    """Transformers that end in ``features``, and the names of its slots."""

    stages: tuple[Transformer, ...]
    slots: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df


def index_stages(categories: dict[str, list[str]],
                 unseen: str) -> list[StringIndexerModel]:
    """One model per column: the many-column builder pads short lists."""
    return [
        StringIndexerModel.from_labels(
            labels, inputCol=c, outputCol=f"{c}_index", handleInvalid=unseen)
        for c, labels in categories.items()
    ]


def scale_stage(df: DataFrame,
                ranges: dict[str, tuple[float, float]]) -> MinMaxScalerModel:
    """A scaler is its minima and maxima, so two rows of those fit it."""
    extremes = df.sparkSession.createDataFrame([
        (Vectors.dense([low for low, _ in ranges.values()]),),
        (Vectors.dense([high for _, high in ranges.values()]),),
    ], ["numeric_vec"])
    return MinMaxScaler(
        inputCol="numeric_vec", outputCol="scaled_vec").fit(extremes)


def feature_stages(df: DataFrame, learned: Learned,
                   unseen: str = "keep") -> FeatureStages:
    """Indexers, one encoder and one scaler; none of them reads ``df``.

    ``unseen="keep"`` sends a category not met in training to a slot that
    encodes as all zeros. ``unseen="error"`` rejects it and drops the least
    frequent known category instead.
    """
    numeric = list(learned.ranges)
    stages: list[Transformer] = []
    slots = [numeric_slot(c) for c in numeric]
    vec_names: list[str] = []
    if learned.categories:
        stages += index_stages(learned.categories, unseen)
        indexed = df
        for stage in stages:
            indexed = stage.transform(indexed)
        vec_names = [f"{c}_vec" for c in learned.categories]
        # sizes come from the indexers' column metadata, not from the rows
        stages.append(OneHotEncoder(
            inputCols=[f"{c}_index" for c in learned.categories],
            outputCols=vec_names, handleInvalid="error").fit(indexed))
        for c, labels in learned.categories.items():
            kept = labels if unseen == "keep" else labels[:-1]
            slots += [category_slot(c, label) for label in kept]
    assembled = VectorAssembler(
        inputCols=[numeric_name(c) for c in numeric], outputCol="numeric_vec")
    features = VectorAssembler(
        inputCols=["scaled_vec", *vec_names], outputCol="features")
    return FeatureStages(
        (*stages, assembled, scale_stage(df, learned.ranges), features),
        tuple(slots))


# --- selection --------------------------------------------------------------

def select_slots(learned: Learned, slots: Sequence[str],
                 top: int = TOP_SLOTS) -> list[int]:
    """Slots with the smallest p-values; equal ones in slot order."""
    order = sorted(range(len(slots)),
                   key=lambda i: (learned.tests[slots[i]].log_p, i))
    return sorted(order[:top])


def chi_square_tests(df: DataFrame, features: str, label: str) -> DataFrame:
    """MLlib's test: one row per slot of a vector of discrete values."""
    return ChiSquareTest.test(df, features, label, True)


def select_slots_by_value(df: DataFrame, features: str = "features",
                          label: str = "label",
                          top: int = TOP_SLOTS) -> list[int]:
    """Rank slots with every distinct value as a category of its own.

    MLlib refuses above 10,000 values per slot, so this suits small tables.
    """
    chosen = chi_square_tests(df, features, label).orderBy(
        "pValue", "featureIndex").limit(top)
    return sorted(r["featureIndex"] for r in chosen.collect())


def slot_slicer(indices: Sequence[int], source: str = "features",
                target: str = "selectedFeatures") -> VectorSlicer:
    return VectorSlicer(inputCol=source, outputCol=target, indices=list(indices))


def slot_layout(learned: Learned, slots: Sequence[str],
                categorical: Sequence[str]) -> list[str]:
    """``slots`` with the best categories of long columns at their places."""
    if not learned.best:
        return list(slots)
    layout = [numeric_slot(c) for c in learned.ranges]
    held = set(slots)
    for c in categorical:
        names = learned.best.get(c) or learned.categories.get(c, ())
        layout += [s for s in (category_slot(c, n) for n in names)
                   if c in learned.best or s in held]
    return layout


def _sql_text(value: str) -> str:
    return f"CAST(X'{value.encode().hex()}' AS STRING)"


def selection_stages(learned: Learned, slots: Sequence[str], layout: Sequence[str],
                     selected: Sequence[int]) -> list[Transformer]:
    """Stages from ``features`` to ``selectedFeatures``.

    Categories of long columns are not in ``features``; each selected one is a
    comparison with its name, so a scored row meets no table.
    """
    if not learned.best:
        return [slot_slicer(selected)]
    place = {slot: i for i, slot in enumerate(slots)}
    chosen = [layout[i] for i in selected]
    known = {category_slot(c, n): (c, n) for c, names in learned.best.items() for n in names}
    inside = [s for s in chosen if s in place]
    outside = [s for s in chosen if s not in place]
    marks = {s: f"selected_{i}" for i, s in enumerate(outside)}
    tests = "".join(
        f", CAST(CAST({sql_name(known[s][0])} AS STRING) <=> {_sql_text(known[s][1])} "
        f"AS DOUBLE) AS {name}" for s, name in marks.items())
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *{tests} FROM __THIS__")]
    parts = list(marks.values())
    if inside:
        stages.append(slot_slicer([place[s] for s in inside], target="selected_inside"))
        parts = ["selected_inside", *parts]
    stages.append(VectorAssembler(inputCols=parts, outputCol="selected_all"))
    order = [*inside, *outside]
    stages.append(slot_slicer([order.index(s) for s in chosen], "selected_all"))
    return stages


def chi_square_table(df: DataFrame, features: Sequence[str],
                     label: str) -> DataFrame:
    """Statistic and degrees of freedom of each discrete column, as a table.

    ``label`` is 0/1 or boolean. Rows shrink to a pair of class counts per
    (feature, value); those are compared with the class totals per feature,
    a table of one row per column that is small enough to broadcast.
    """
    pairs = F.array(*(
        F.struct(F.lit(c).alias("feature"),
                 F.col(c).cast("string").alias("value"))
        for c in features
    ))
    cells = (
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).cast("boolean").alias("one"),
                F.explode(pairs).alias("s"))
        .select("one", "s.*")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if(~F.col("one")).cast("double").alias("n0"),
             F.count_if("one").cast("double").alias("n1"))
    )
    totals = cells.groupBy("feature").agg(
        F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    row = F.col("n0") + F.col("n1")
    whole = F.col("t0") + F.col("t1")

    def part(seen: str, total: str) -> Column:
        expected = row * F.col(total) / whole
        return F.coalesce(
            F.pow(F.col(seen) - expected, 2) / F.nullif(expected, F.lit(0.0)),
            F.lit(0.0))

    two_classes = F.when((F.max("t0") > 0) & (F.max("t1") > 0), 1).otherwise(0)
    return (
        cells.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.sum(part("n0", "t0") + part("n1", "t1")).alias("statistic"),
             ((F.count(F.lit(1)) - 1) * two_classes).alias("dof"))
    )
