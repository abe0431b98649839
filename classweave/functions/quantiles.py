"""Quantiles: a one-pass sketch, and an exact form that stays distributed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Quantiles = dict[str, list[float] | None]


def finite(df: DataFrame, column: str) -> Column:
    """The column as a double, with NaN turned into null."""
    value = F.col(column)
    kind = df.schema[_resolve(df, column)].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    return value.cast("double")


def _resolve(df: DataFrame, column: str) -> str:
    """Schema spelling of a column found without regard to case."""
    if column in df.columns:
        return column
    matches = [c for c in df.columns if c.lower() == column.lower()]
    if len(matches) != 1:
        raise ValueError(f"column {column!r} not found in {df.columns}")
    return matches[0]


def quantiles(df: DataFrame, columns: Sequence[str],
              probabilities: Sequence[float],
              relative_error: float = 0.05) -> Quantiles:
    """Quantiles of every column in one job; None for a column with no value.

    A positive ``relative_error`` uses the mergeable sketch. Zero gives exact
    values through :func:`exact_quantiles`, since a zero-error sketch would
    gather every value on the driver.
    """
    if relative_error <= 0:
        return exact_quantiles(df, columns, probabilities)
    found = df.select(
        *(finite(df, c).alias(c) for c in columns)
    ).approxQuantile(list(columns), list(probabilities), relative_error)
    return {c: (values or None) for c, values in zip(columns, found)}


@dataclass
class _Target:
    """One wanted rank, known to lie strictly between ``low`` and ``high``.

    ``None`` bounds are open. ``below`` counts the values at or under ``low``;
    ``rows`` counts those inside the interval.
    """

    column: str
    rank: int
    below: int
    rows: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        value = F.col(self.column)
        keep = value.isNotNull()
        if self.low is not None:
            keep = keep & (value > F.lit(self.low))
        if self.high is not None:
            keep = keep & (value < F.lit(self.high))
        return F.when(keep, value)

    def narrow(self, edges: Sequence[float],
               counts: dict[float, tuple[int, int]]) -> None:
        """Shrink the interval with exact counts under and up to each edge."""
        upper_count = self.below + self.rows
        for edge in edges:
            under, up_to = counts[edge]
            if under < self.rank <= up_to:
                self.value = edge
                return
            if up_to < self.rank and up_to >= self.below:
                self.low, self.below = edge, up_to
            if under >= self.rank and under <= upper_count:
                self.high, upper_count = edge, under
        self.rows = upper_count - self.below


def exact_quantiles(df: DataFrame, columns: Sequence[str],
                    probabilities: Sequence[float],
                    finish_rows: int = 200_000,
                    accuracy: int = 10_000) -> Quantiles:
    """The smallest value whose cumulative share reaches each probability.

    Each round sketches the values still in question, counts exactly around
    the sketched edges and keeps the part that holds the wanted rank. A round
    shrinks that part to a few ten-thousandths, however often a single value
    repeats, because an edge that repeats is decided by its own counts. Once
    every part holds at most ``finish_rows`` rows one grouped job ends it.
    Only counts and edges reach the driver.
    """
    values = df.select(*(finite(df, c).alias(c) for c in columns))
    totals = values.agg(
        *(F.count(F.col(c)).alias(c) for c in columns)
    ).first()
    targets = {
        (c, p): _Target(c, _rank(p, totals[c]), 0, totals[c])
        for c in columns for p in probabilities if totals[c]
    }
    while True:
        wide = [t for t in targets.values()
                if t.value is None and t.rows > finish_rows]
        if not wide:
            break
        _narrow_all(values, wide, accuracy)
    _finish(values, [t for t in targets.values() if t.value is None])
    return {
        c: [targets[c, p].value for p in probabilities] if totals[c] else None
        for c in columns
    }


def _rank(probability: float, rows: int) -> int:
    exact = Decimal(str(probability)) * rows
    return min(rows, max(1, math.ceil(exact)))


def _narrow_all(values: DataFrame, targets: Sequence[_Target],
                accuracy: int) -> None:
    """Targets in the same interval share a sketch; all edges share a count."""
    margin = 2.0 / accuracy
    intervals: dict[tuple, list[_Target]] = {}
    for t in targets:
        intervals.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for i, own in enumerate(intervals.values()):
        shares = [(t.rank - t.below) / t.rows for t in own]
        wanted = sorted({
            min(1.0, max(0.0, share + step))
            for share in shares for step in (-margin, 0.0, margin)})
        sketches.append(F.percentile_approx(
            own[0].inside(), wanted, accuracy).alias(f"i{i}"))
    sketched = values.agg(*sketches).first()
    edges: dict[str, set[float]] = {}
    for i, (column, _, _) in enumerate(intervals):
        edges.setdefault(column, set()).update(sketched[f"i{i}"])
    counted = _count_around(values, {c: sorted(e) for c, e in edges.items()})
    for t in targets:
        t.narrow(sorted(edges[t.column]), counted[t.column])


def _count_around(values: DataFrame, edges: dict[str, list[float]]
                  ) -> dict[str, dict[float, tuple[int, int]]]:
    """How many values lie under, and up to, each edge of each column.

    A value's code is how many edges it reaches plus how many it exceeds, so
    equal codes mean the same place among the edges and rows shrink to one
    count per place.
    """
    places = []
    for column, own in edges.items():
        code = F.lit(0)
        for edge in own:
            code = (code + (F.col(column) >= F.lit(edge)).cast("int")
                    + (F.col(column) > F.lit(edge)).cast("int"))
        places.append(F.struct(F.lit(column).alias("column"), code.alias("code")))
    rows = (
        values.select(F.explode(F.array(*places)).alias("s")).select("s.*")
        .filter(F.col("code").isNotNull())
        .groupBy("column", "code").agg(F.count("*").alias("n")).collect()
    )  # at most two rows per edge and one more
    counts: dict[str, dict[int, int]] = {}
    for row in rows:
        counts.setdefault(row["column"], {})[row["code"]] = row["n"]
    return {
        column: {
            edge: (
                sum(n for code, n in counts[column].items() if code <= 2 * i),
                sum(n for code, n in counts[column].items() if code <= 2 * i + 1),
            )
            for i, edge in enumerate(own)
        }
        for column, own in edges.items()
    }


def _finish(values: DataFrame, targets: Sequence[_Target]) -> None:
    """Rank the few rows left per target, with equal values counted first."""
    if not targets:
        return
    candidates = F.array(*(
        F.struct(
            F.lit(i).alias("target"),
            F.lit(t.rank - t.below).cast("long").alias("rank"),
            t.inside().alias("value"),
        )
        for i, t in enumerate(targets)
    ))
    counted = (
        values.select(F.explode(
            F.filter(candidates, lambda s: s["value"].isNotNull())
        ).alias("s"))
        .groupBy("s.target", "s.rank", "s.value").agg(F.count("*").alias("n"))
    )
    running = F.sum("n").over(
        Window.partitionBy("target").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = (
        counted.withColumn("upto", running)
        .filter((F.col("upto") >= F.col("rank"))
                & (F.col("upto") - F.col("n") < F.col("rank")))
        .select("target", "value")
    )
    for row in hits.collect():  # one row per target
        targets[row["target"]].value = row["value"]
