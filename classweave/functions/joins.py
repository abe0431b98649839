"""Joins with a table of one row per key, whatever share of rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a key with one row in so many is hot, so there are no more hot keys than that
HOT_SHARE = 1000
# groups that rows without a partner are dealt to
SPREAD = 4096


def lookup(df: DataFrame, key: Column, table: DataFrame, count: str,
           total: int) -> DataFrame:
    """``df`` with the columns of ``table`` but ``key`` and ``count``; null without a match.

    ``table`` has one row per ``key`` (text) and says in ``count`` how many of
    about ``total`` rows hold it. The hot keys, at most ``HOT_SHARE``, are
    broadcast. The others are joined by a shuffle, in which rows of hot keys and
    of null are dealt out over keys that match nothing.
    """
    names = [c for c in table.columns if c not in ("key", count)]
    is_hot = F.col(count) * HOT_SHARE >= total
    hot = table.filter(is_hot).select(
        F.col("key").alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in names))
    rest = table.filter(~is_hot).select(
        F.concat(F.lit("="), "key").alias("_key"),
        *(F.col(c).alias(f"_rest_{c}") for c in names))
    spread = F.concat(F.lit("-"), F.pmod(
        F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    return (
        df.withColumn("_own", key)
        .join(F.broadcast(hot), F.col("_own") == F.col("_hot"), "left")
        .withColumn("_key", F.when(
            F.col("_own").isNull() | F.col("_hot").isNotNull(), spread
        ).otherwise(F.concat(F.lit("="), "_own")))
        .join(rest, "_key", "left")
        .select(*(F.col(f"`{c}`") for c in df.columns),
                *(F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in names))
    )
