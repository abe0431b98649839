"""Categories as a written table, for columns with too many for a model to hold.

A model's own indexer carries every category of a column, on the driver and in
every task. Here a column's categories, their order, class counts and chi-square
statistics are rows of a table; rows to encode are joined with it, and the best
categories are found by a distributed top-k. The driver sees a row per column and
the few categories that are selected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classweave.functions.joins import lookup
from classweave.functions.running import global_rank
from classweave.session import materialise, new_folder


@dataclass(frozen=True)
class CategoryTable:
    """``column, category, idx, n, n0, n1, statistic``, written.

    ``idx`` numbers a column's categories from zero, most frequent first, ties
    by name. ``sizes`` and ``totals`` are the categories and rows of each column.
    """

    rows: DataFrame
    sizes: dict[str, int]
    totals: dict[str, int]

    def best(self, columns: Sequence[str], top: int) -> list:
        """The ``top`` rows with the smallest p-values, ties by column and index.

        Every test has one degree of freedom, so a larger statistic is a
        smaller p-value, also where that is too small for a double.
        """
        place = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
        kept = self.rows.filter(F.col("column").isin(list(columns)))
        return kept.orderBy(F.desc("statistic"), place, "idx").limit(top).collect()


def category_table(cells: DataFrame, columns: Sequence[str],
                   classes: tuple[int, int]) -> CategoryTable:
    """The table of class counts per (feature, category), which is written.

    ``classes`` are the rows of each class. A category of all rows, or one
    class alone, leaves nothing to test: the statistic is zero.
    """
    n0, n1 = (F.col(c).cast("double") for c in ("n0", "n1"))
    t0, t1 = (F.lit(float(t)) for t in classes)
    row, whole = n0 + n1, t0 + t1
    gap = n0 * t1 - n1 * t0
    statistic = F.coalesce(
        gap * gap * whole / F.nullif(row * (whole - row) * t0 * t1, F.lit(0.0)), F.lit(0.0))
    counts = cells.filter(
        F.col("feature").isin(list(columns)) & F.col("category").isNotNull()
    ).select(F.col("feature").alias("column"), "category",
             (F.col("n0") + F.col("n1")).alias("n"), "n0", "n1")
    ranked = global_rank(counts, ["column", F.desc("n"), "category"])
    # one row per column
    starts = ranked.groupBy("column").agg(F.min("rank").alias("start"))
    rows = materialise(ranked.join(F.broadcast(starts), "column").select(
        "column", "category", (F.col("rank") - F.col("start")).cast("double").alias("idx"),
        "n", "n0", "n1", statistic.alias("statistic")))
    found = {r["column"]: r for r in rows.groupBy("column").agg(
        F.count("*").alias("size"), F.sum("n").alias("total")).collect()}
    return CategoryTable(
        rows, {c: found[c]["size"] if c in found else 0 for c in columns},
        {c: found[c]["total"] if c in found else 0 for c in columns})


def with_indices(df: DataFrame, table: CategoryTable,
                 columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_index`` by joins; null for a null or an unknown category."""
    for c in columns:
        own = table.rows.filter(F.col("column") == c).select(
            F.col("category").alias("key"), "n", F.col("idx").alias(f"{c}_index"))
        df = lookup(df, F.col(c).cast("string"), own, "n", table.totals[c])
    return df


def sparse_slots(numbers: Sequence[Column], table: CategoryTable,
                 columns: Sequence[str]) -> Column:
    """A sparse vector's parts: all ``numbers``, then one slot per category.

    The rows carry ``<column>_index``; where it is null all slots are zero.
    """
    start, slots = len(numbers), []
    for c in columns:
        slots.append(F.col(f"{c}_index").cast("int") + start)
        start += table.sizes[c]
    found = F.filter(F.array(*slots), lambda i: i.isNotNull()) if slots else F.array()
    first = F.array(*(F.lit(i) for i in range(len(numbers)))).cast("array<int>")
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(start).alias("size"),
        F.concat(first, found.cast("array<int>")).alias("indices"),
        F.concat(F.array(*numbers).cast("array<double>"),
                 F.transform(found, lambda _: F.lit(1.0))).alias("values"))


def as_vectors(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back with ``sparse_slots`` as a vector column.

    A vector is stored as those parts, so no row passes through Python.
    """
    path = new_folder(df.sparkSession, "vectors")
    df.write.parquet(path)
    schema = T.StructType([
        T.StructField(name, VectorUDT()) if f.name == name else f for f in df.schema])
    return df.sparkSession.read.schema(schema).parquet(path)
