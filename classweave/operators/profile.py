"""Exploration: statistics, missing values, distributions, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.functions.hashing import hash_below, hash_hex
from classweave.functions.quantiles import finite, quantiles

# empty bins are listed up to this many bins; beyond, only filled ones are rows
MAX_LISTED_BINS = 100_000
# bin numbers must be longs
MOST_BINS = 1 << 62
# a kernel is left out where it is below this share of its peak
KERNEL_ERROR = 1e-15
# variances smaller than this share of their terms are rounding
NO_SPREAD = 1e-12


def preview(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows in key order: a top-k, not a full sort."""
    return df.orderBy(*order).limit(rows)


def schema_table(df: DataFrame) -> DataFrame:
    """Column names, types and nullability, with the count of values held."""
    counted = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return _unpivot(counted, [
        (f.name, {
            "type": F.lit(f.dataType.simpleString()),
            "nullable": F.lit(f.nullable),
            "n_values": F.col(f"`{f.name}`"),
        })
        for f in df.schema.fields
    ])


def _unpivot(row: DataFrame, items: Sequence[tuple[str, dict[str, Column]]],
             name: str = "column") -> DataFrame:
    """One wide row to one row per item."""
    structs = [
        F.struct(F.lit(key).alias(name),
                 *(c.alias(n) for n, c in fields.items()))
        for key, fields in items
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation and range of each column in one pass.

    NaN counts as missing. Numbers fill ``min``/``max``; text fills
    ``min_text``/``max_text`` and has a null mean.
    """
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        value = finite(df, c) if _is_numeric(df, c) else F.col(c)
        aggs.append(F.count(value).alias(f"n{i}"))
        aggs.append(F.min(value).alias(f"lo{i}"))
        aggs.append(F.max(value).alias(f"hi{i}"))
        if _is_numeric(df, c):
            aggs.append(F.avg(value).alias(f"avg{i}"))
            aggs.append(F.stddev_samp(value).alias(f"sd{i}"))
    none = F.lit(None)
    items = []
    for i, c in enumerate(columns):
        number = _is_numeric(df, c)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        items.append((c, {
            "count": F.col(f"n{i}"),
            "mean": (F.col(f"avg{i}") if number else none).cast("double"),
            "stddev": (F.col(f"sd{i}") if number else none).cast("double"),
            "min": (low if number else none).cast("double"),
            "max": (high if number else none).cast("double"),
            "min_text": (none if number else low).cast("string"),
            "max_text": (none if number else high).cast("string"),
        }))
    return _unpivot(df.agg(*aggs), items)


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN where the type can hold one."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(missing(df, c)).alias(c) for c in columns),
    )
    return _unpivot(counted, [
        (c, {"n_rows": F.col("_rows"), "n_missing": F.col(c)}) for c in columns
    ])


def _range_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(count, min, max) of each column, NaN ignored, in one job."""
    aggs = []
    for i, c in enumerate(columns):
        value = finite(df, c)
        aggs += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"),
                 F.max(value).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"])
            for i, c in enumerate(columns)}


def automatic_bins(df: DataFrame, column: str,
                   relative_error: float = 0.001) -> int:
    """Bin count from the narrower of the Sturges and Freedman-Diaconis widths.

    Whole-number columns never get bins narrower than one.
    """
    n, low, high = _range_of(df, [column])[column]
    if not n or low == high:
        return 1
    width = (high - low) / (math.log2(n) + 1)
    found = quantiles(df, [column], [0.25, 0.75], relative_error)[column]
    spread = 2.0 * (found[1] - found[0]) / n ** (1.0 / 3.0)
    if spread > 0:
        width = min(width, spread)
    if isinstance(finite_type(df, column), T.IntegralType):
        width = max(width, 1.0)
    return min(math.ceil((high - low) / width), MOST_BINS)


def finite_type(df: DataFrame, column: str) -> T.DataType:
    return df.select(column).schema.fields[0].dataType


def bin_number(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a value in [low, high]; the top edge joins the last."""
    if high <= low:
        return F.when(value.isNotNull(), F.lit(0).cast("bigint"))
    width = (high - low) / bins
    raw = F.floor((value - F.lit(low)) / F.lit(width))
    return F.when(value.isNotNull(), F.least(raw, F.lit(bins - 1).cast("bigint")))


def histogram(df: DataFrame, column: str, bins: int | str = "auto") -> DataFrame:
    """Rows per equal-width bin, empty bins included up to ``MAX_LISTED_BINS`` bins.

    One far value can call for more bins than there are rows. Then only filled
    bins are rows, so the result never has more rows than the larger of that
    bound and the number of values.
    """
    if bins == "auto":
        bins = automatic_bins(df, column)
    n, low, high = _range_of(df, [column])[column]
    if not n:
        return df.sparkSession.createDataFrame(
            [], "bin BIGINT, lo DOUBLE, hi DOUBLE, n BIGINT")
    counts = (
        df.select(bin_number(finite(df, column), low, high, bins).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    if bins <= MAX_LISTED_BINS:
        grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
        counts = grid.join(counts, "bin", "left")
    width = (high - low) / bins
    return counts.select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(df: DataFrame, column: str, grid: int = 200,
            bins: int | None = 1024) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    Rows first shrink to bin counts placed at each bin's mean. ``bins=None`` uses
    every distinct value and is exact; that suits whole-number columns. A bin or
    value meets only the grid points in reach of its kernel, where that is at
    least ``KERNEL_ERROR`` of its peak; a density is short by no more than that
    share of the highest one possible. The grid covers the data either way.
    """
    value = finite(df, column)
    stats = df.agg(
        F.count(value).alias("n"), F.min(value).alias("lo"),
        F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"),
    ).first()
    n, low, high, deviation = stats["n"], stats["lo"], stats["hi"], stats["sd"]
    if not deviation:
        raise ValueError(f"{column} has no spread; no density to estimate")
    group = (value if bins is None else bin_number(value, low, high, bins))
    points = (
        df.select(group.alias("g"), value.alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("centre"))
    )
    bandwidth = deviation * n ** -0.2
    step = (high - low) / (grid - 1)
    scale = 1.0 / (n * bandwidth * math.sqrt(2.0 * math.pi))
    at = F.lit(low) + F.col("i") * F.lit(step)
    z = (at - F.col("centre")) / F.lit(bandwidth)
    reach = bandwidth * math.sqrt(-2.0 * math.log(KERNEL_ERROR))
    first = F.ceil((F.col("centre") - F.lit(low + reach)) / F.lit(step))
    last = F.floor((F.col("centre") - F.lit(low - reach)) / F.lit(step))
    inside = F.sequence(
        F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(grid - 1)).cast("int"))
    met = (
        points.select("n", "centre", first.alias("first"), last.alias("last"))
        # a kernel narrower than a step may meet no point
        .filter("first <= last")
        .select("n", "centre", F.explode(inside).alias("i"))
        .groupBy("i")
        .agg((F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z))
              * F.lit(scale)).alias("density"))
    )
    every = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("i"))
    return every.join(met, "i", "left").select(
        "i", at.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, as (col_x, col_y, corr).

    A pair uses the rows where both hold a number, at any width; NaN counts as
    missing. It is null where either has no spread in those rows.

    Two passes over the rows however many columns there are. The first takes
    means and deviations; the second adds up the products of all pairs of
    scaled values, with the marks of present values and the squares beside them
    where a column has gaps. Every task adds up one such matrix, and the driver
    gets one, so its size is bound by the number of columns.
    """
    columns = list(columns)
    held = df.select(*(finite(df, c).alias(f"c{i}") for i, c in enumerate(columns)))
    stats = held.agg(F.count(F.lit(1)).alias("rows"), *(
        f(f"c{i}").alias(f"{name}{i}") for i in range(len(columns))
        for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop)))).first()
    gaps = [i for i in range(len(columns)) if stats[f"n{i}"] < stats["rows"]]
    values, squares = [], []
    for i in range(len(columns)):
        spread = stats[f"sd{i}"] or 0.0
        scaled = F.lit(0.0) if not spread else (
            F.col(f"c{i}").cast("double") - F.lit(stats[f"mean{i}"])) / F.lit(spread)
        values.append(F.coalesce(scaled, F.lit(0.0)))
        squares.append(values[-1] * values[-1])
    marks = [F.col(f"c{i}").isNotNull().cast("double") for i in gaps]
    parts = [F.lit(1.0), *values, *marks, *(squares if gaps else [])]
    gram = _products(held.select(array_to_vector(F.array(*parts)).alias("v")), len(parts))
    found = _pair_correlations(gram, len(columns), gaps)
    rows = [(x, y, None if np.isnan(found[i, j]) else float(found[i, j]))
            for i, x in enumerate(columns) for j, y in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "col_x STRING, col_y STRING, corr DOUBLE")


def _products(vectors: DataFrame, size: int) -> np.ndarray:
    """Sums of the products of all pairs of a vector column's entries."""
    old = MLUtils.convertVectorColumnsFromML(vectors, "v")
    if old.isEmpty():
        return np.zeros((size, size))
    return RowMatrix(old, 0, size).computeGramianMatrix().toArray()


def _pair_correlations(gram: np.ndarray, n: int, gaps: Sequence[int]) -> np.ndarray:
    """Correlations from the sums over each pair's shared rows; NaN for none."""
    value = slice(1, 1 + n)
    # the column of products that stands for a value being there
    present = np.zeros(n, int)
    present[list(gaps)] = 1 + n + np.arange(len(gaps))
    count = gram[np.ix_(present, present)]
    total = gram[value][:, present]  # of x, where y is there
    if gaps:
        square = gram[1 + n + len(gaps):][:, present]
    else:
        square = np.repeat(np.diag(gram)[value, None], n, axis=1)
    both = gram[value, value]
    spread = count * square - total * total
    spread[spread <= NO_SPREAD * count * square] = np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        found = (count * both - total * total.T) / np.sqrt(spread) / np.sqrt(spread.T)
    return np.clip(found, -1.0, 1.0)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Rows per cell of an even grid over two columns."""
    ranges = _range_of(df, [x, y])
    cells = [
        bin_number(finite(df, c), ranges[c][1], ranges[c][2], bins).alias(name)
        for c, name in ((x, "bx"), (y, "by"))
    ]
    return (
        df.select(*(c.cast("int").alias(n) for c, n in zip(cells, ("bx", "by"))))
        .filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
        .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_sample(df: DataFrame, x: str, y: str, key: Sequence[str],
                   fraction: float, seed: int = 7) -> DataFrame:
    """Raw points for a plot: a stable sample of about ``fraction`` of rows."""
    return df.filter(hash_below(key, seed, fraction)).select(x, y)


def scatter_points(df: DataFrame, x: str, y: str, key: Sequence[str],
                   points: int, seed: int = 7) -> DataFrame:
    """Raw points for a plot: exactly ``points`` of them, or all if there are fewer.

    Those with the smallest hash of their key, so the sample is the same under
    any partitioning; each task keeps no more than ``points``.
    """
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(
        hash_hex(key, seed), *key).limit(points).select(x, y)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Majority and minority label with their counts and min/max ratio.

    Equal counts are ordered by label, so the two never name the same class.
    """
    counts = label_counts(df.filter(F.col(label).isNotNull()), label)
    ranked = F.struct(F.col("n"), F.col(label).alias("label"))
    return (
        counts.agg(F.max(ranked).alias("hi"), F.min(ranked).alias("lo"))
        .select(
            F.col("hi.label").alias("majority_label"),
            F.col("hi.n").alias("majority_count"),
            F.col("lo.label").alias("minority_label"),
            F.col("lo.n").alias("minority_count"),
            (F.col("lo.n") / F.col("hi.n")).alias("ratio"),
        )
    )

