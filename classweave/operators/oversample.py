"""Synthetic minority rows between neighbours, as an alternative to sampling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classweave.functions.hashing import HASH_SPACE, hash_below, hash_number
from classweave.operators.neighbours import nearest
from classweave.operators.sampling import SEED, Balance, minority_rows

NEIGHBOURS = 5


def synthetic_minority(df: DataFrame, balance: Balance, key: str, size: int,
                       features: str = "features", label: str = "label",
                       neighbours: int = NEIGHBOURS, seed: int = SEED,
                       **options: int) -> DataFrame:
    """(parent, copy, features, label): as many as the minority lacks.

    Each row lies on the line from a minority row to one of its nearest
    neighbours among the minority, found exactly. Every minority row gives the
    same whole number of copies and a hash of its key decides who gives one
    more. Hashes also pick the neighbour and the place on the line. A minority
    of one row has no neighbour: its copies are the row itself. ``key`` is a
    unique column of whole numbers.
    """
    wanted = 1.0 / balance.ratio - 1.0
    whole = int(wanted)
    points = minority_rows(df, balance, label).select(
        F.col(key).alias("id"), vector_to_array(features).alias("x"))
    copies = F.lit(whole) + hash_below(["id"], seed, wanted - whole).cast("int")
    # a row without neighbours stands in for them
    pick = hash_number(["id", "copy"], seed) % F.greatest(F.size("near"), F.lit(1))
    other = F.coalesce(F.get("near", pick.cast("int"))["x"], F.col("x"))
    way = hash_number(["copy", "id"], seed + 1) / F.lit(float(HASH_SPACE))
    return (
        nearest(points, size, neighbours, **options)
        .withColumn("copies", copies)
        .filter(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumns({"other": other, "way": way})
        .select(
            F.col("id").alias("parent"), "copy",
            array_to_vector(F.zip_with(
                "x", "other", lambda a, b: a + F.col("way") * (b - a)
            )).alias(features),
            F.lit(balance.minority).alias(label),
        )
    )
