"""Ranks and running totals of a whole table, with no task sorting all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classweave.session import materialise

SINGLE_WINDOW_ROWS = 2_000_000

# ``monotonically_increasing_id``: partition in the upper bits, row in these
ROW_BITS = 33


def running_totals(df: DataFrame, order: str, sums: Sequence[str],
                   window_rows: int = SINGLE_WINDOW_ROWS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_upto`` for each column in ``sums``, by ascending ``order``.

    Totals start anew in every segment, the rows that agree on ``by``. ``df``
    holds one row per distinct ``order`` value of a segment, no nulls, and is
    read several times, so pass a written or persisted table.

    Above ``window_rows`` rows the whole table, all segments together, is cut by
    range into stretches of about that many rows, and written. A stretch is
    totalled on its own and shifted by the sum of the segment's earlier ones,
    so neither one large segment nor a great many small ones fill a task. There
    are about as many offsets as stretches and segments together.
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    ranged = _in_stretches(df, order, window_rows, by)
    if ranged is None:
        whole = Window.partitionBy(*by).orderBy(order).rowsBetween(*frame)
        return df.select(
            "*", *(F.sum(c).over(whole).alias(f"{c}_upto") for c in sums)
        )

    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*by, "_stretch")
        .agg(*(F.sum(c).alias(c) for c in sums))
        .select(
            *by, "_stretch",
            *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before")
              for c in sums),
        )
    )
    within = Window.partitionBy(*by, "_stretch").orderBy(order).rowsBetween(*frame)
    return (
        ranged.join(offsets, [*by, "_stretch"])
        .select(
            *df.columns,
            *((F.sum(c).over(within) + F.col(f"_{c}_before"))
              .alias(f"{c}_upto") for c in sums),
        )
    )


def _in_stretches(df: DataFrame, order: str, window_rows: int,
                  by: Sequence[str]) -> DataFrame | None:
    """``df`` cut by range into numbered stretches and written; None if one will do."""
    stretches = -(-df.count() // window_rows)
    if stretches <= 1:
        return None
    return materialise(df.repartitionByRange(stretches, *by, order).withColumn(
        "_stretch", F.spark_partition_id()))


def preceding(df: DataFrame, order: str, columns: Sequence[str],
              window_rows: int = SINGLE_WINDOW_ROWS,
              by: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_before``: the value of the row before, by ascending ``order``.

    Null for the first row of a segment. ``df`` as for :func:`running_totals`,
    and cut like there; a stretch gets the last row of the one before it.
    """
    ranged = _in_stretches(df, order, window_rows, by)
    if ranged is None:
        whole = Window.partitionBy(*by).orderBy(order)
        return df.select("*", *(F.lag(c).over(whole).alias(f"{c}_before") for c in columns))
    # one row per stretch and segment
    ends = ranged.groupBy(*by, "_stretch").agg(
        F.max_by(F.struct(*columns), order).alias("end"))
    earlier = Window.partitionBy(*by).orderBy("_stretch")
    ends = ends.select(*by, "_stretch", F.lag("end").over(earlier).alias("_end"))
    within = Window.partitionBy(*by, "_stretch").orderBy(order)
    return ranged.join(ends, [*by, "_stretch"]).select(
        *df.columns,
        *(F.coalesce(F.lag(c).over(within), F.col("_end")[c]).alias(f"{c}_before")
          for c in columns))


def global_rank(df: DataFrame, order: Sequence[Column | str],
                name: str = "rank") -> DataFrame:
    """Add the row's position, from zero, in the order of unique sort keys.

    Spark sorts by range, so every partition holds one stretch of the order.
    The sorted rows are written with their place in their partition; adding
    the sizes of the partitions before it makes the place global.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition, so the window and the broadcast are small
    offsets = placed.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + row).alias(name))
