"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classweave.session import materialise


def _state(links: DataFrame) -> tuple:
    """A number that changes when the links do."""
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``).

    The component is the smallest node that links reach. Both ends are bigint;
    rows with a null end or a link to itself are ignored, and repeated links
    count once. A node without links is not returned.

    Each round hangs every node's larger neighbours on its smallest neighbour,
    then every node's smaller neighbours too. Links never grow in number, the
    minima are combined before the shuffle, and each round is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    forest = materialise(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct())
    state = _state(forest)
    while state[0]:
        both = forest.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            forest.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # a written step keeps the two joins in plans of their own
        large = materialise(large)
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(roots, "hi")
        small = joined.where("lo <> m").select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            joined.select("hi", F.col("m").alias("lo"))).distinct()
        forest = materialise(small)
        before, state = state, _state(forest)
        if state == before:
            break
    return forest.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        forest.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
