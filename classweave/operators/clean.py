"""Outlier fences and imputation, fitted once and applied as plain SQL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classweave.functions.quantiles import Quantiles, finite, quantiles

FENCE_WIDTH = 1.5


def sql_name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def sql_double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


@dataclass(frozen=True)
class Fence:
    column: str
    q1: float
    q3: float
    lower: float
    upper: float


@dataclass(frozen=True)
class Fences:
    """Interquartile fences of a table.

    ``empty`` lists columns without a value; ``flat`` lists columns whose
    quartiles are equal, whose fence keeps that one value only.
    """

    fences: tuple[Fence, ...]
    empty: tuple[str, ...] = ()
    flat: tuple[str, ...] = ()

    def sql(self) -> str:
        """True inside every fence; null where a fenced column is null."""
        tests = [
            f"{sql_name(f.column)} BETWEEN {sql_double(f.lower)} "
            f"AND {sql_double(f.upper)}"
            for f in self.fences
        ]
        return "(" + " AND ".join(tests) + ")" if tests else "TRUE"

    def inside(self) -> Column:
        tests = [
            F.col(f.column).between(F.lit(f.lower), F.lit(f.upper))
            for f in self.fences
        ]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def filter(self, df: DataFrame) -> DataFrame:
        """Rows inside every fence. A null in a fenced column drops the row."""
        return df.filter(self.inside())

    def flag(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        """Every row, marked true where :meth:`filter` would drop it."""
        return df.withColumn(name, ~F.coalesce(self.inside(), F.lit(False)))

    def stage(self, name: str = "is_outlier") -> SQLTransformer:
        return SQLTransformer(statement=(
            f"SELECT *, NOT coalesce({self.sql()}, FALSE) AS {sql_name(name)} "
            "FROM __THIS__"
        ))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(f.column, f.q1, f.q3, f.lower, f.upper) for f in self.fences],
            "column STRING, q1 DOUBLE, q3 DOUBLE, lower DOUBLE, upper DOUBLE",
        )


def fences_from(found: Quantiles, columns: Sequence[str],
                skip_flat: bool = False, low: int = 0, high: int = 1,
                width: float = FENCE_WIDTH) -> Fences:
    """Fences from quartiles at positions ``low`` and ``high`` of each list."""
    fences, empty, flat = [], [], []
    for c in columns:
        values = found[c]
        if values is None:
            empty.append(c)
            continue
        q1, q3 = values[low], values[high]
        if q1 == q3:
            flat.append(c)
            if skip_flat:
                continue
        reach = width * (q3 - q1)
        fences.append(Fence(c, q1, q3, q1 - reach, q3 + reach))
    return Fences(tuple(fences), tuple(empty), tuple(flat))


def fit_fences(df: DataFrame, columns: Sequence[str],
               relative_error: float = 0.05,
               skip_flat: bool = False) -> Fences:
    """Fences of all columns from one quantile job over the raw table."""
    found = quantiles(df, columns, [0.25, 0.75], relative_error)
    return fences_from(found, columns, skip_flat)


@dataclass(frozen=True)
class Fills:
    """The value that stands in for a missing one, per column.

    ``empty`` lists columns that held no value to learn from; they take
    ``0.0`` so that a row can still be assembled.
    """

    values: dict[str, float]
    empty: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(finite(df, c), F.lit(v))
            for c, v in self.values.items()
        })

    def sql(self, column: str) -> str:
        """Works for any numeric type; ``nanvl`` needs the double cast."""
        value = f"CAST({sql_name(column)} AS DOUBLE)"
        fill = sql_double(self.values[column])
        return f"nanvl(coalesce({value}, {fill}), {fill})"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c, float(v)) for c, v in self.values.items()],
            "column STRING, fill DOUBLE",
        )


def fills_from(found: dict[str, float | None]) -> Fills:
    empty = tuple(c for c, v in found.items() if v is None)
    return Fills({c: 0.0 if v is None else float(v) for c, v in found.items()},
                 empty)


def fit_fills(df: DataFrame, columns: Sequence[str], strategy: str = "median",
              relative_error: float = 0.001) -> Fills:
    """Learn mean, median or mode of each column.

    A tie for the mode goes to the smallest value. The mode counts values per
    column before comparing them, so a value held by most rows costs one
    partial count per task.
    """
    columns = list(columns)
    if strategy == "mean":
        row = df.agg(*(F.avg(finite(df, c)).alias(c) for c in columns)).first()
        return fills_from({c: row[c] for c in columns})
    if strategy == "median":
        found = quantiles(df, columns, [0.5], relative_error)
        return fills_from({c: v[0] if v else None for c, v in found.items()})
    if strategy != "mode":
        raise ValueError(f"unknown strategy {strategy!r}")
    pairs = F.array(*(
        F.struct(F.lit(c).alias("column"), finite(df, c).alias("value"))
        for c in columns
    ))
    modes = (
        df.select(F.explode(pairs).alias("s")).select("s.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(F.max(F.struct("n", (-F.col("value")).alias("down"))).alias("top"))
        .select("column", (-F.col("top.down")).alias("value"))
    )
    found = {r["column"]: r["value"] for r in modes.collect()}  # one per column
    return fills_from({c: found.get(c) for c in columns})
