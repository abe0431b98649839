"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most two bits either differ in at most one bit of the first segment
or agree on the second, so a probe with every value of a small Hamming ball
around the first segment (itself and each single flip) and one with the second
segment as it is meet every partner; whole distances are then verified.

Texts are collapsed to distinct fingerprints first, so copies cost one row. A
segment value held by more than ``crowded`` fingerprints would pair them all;
its fingerprints are left out of the tables and meet instead on the Hamming ball
over both segments: two values within two bits share a value within one bit of
each, so hanging every meeting value's members on the smallest of them keeps
every connection with 65 rows a fingerprint. A pair escapes the tables only if
both its members are crowded, and then both take that way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.components import components
from classweave.session import materialise

SHINGLE_WORDS = 3
HASH_SEED = 42
DISTANCE = 2
SEGMENT_BITS = 32
# fingerprints that may share a segment value and still be paired by it
CROWDED = 32


def fingerprint(raw: bytes) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit number.

    Words are runs without ASCII white space, A-Z in lower case. A bit is set if
    it is set in over half the hashes of all three-word shingles, repeats
    included; fewer words make one shingle, and no words give zero.
    """
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1]).tolist()
    ends = (ends - 1).tolist()
    width = min(SHINGLE_WORDS, len(words))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hash_of(line[low:high], HASH_SEED)
         for low, high in zip(starts, ends[width - 1:])),
        np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        bits = np.unpackbits(
            part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    """Fingerprints of whole texts; null counts as empty."""

    def of_batch(texts: pa.Array) -> pa.Array:
        raw = pc.fill_null(texts, "").cast(pa.large_binary())
        return pa.array((fingerprint(x.as_py()) for x in raw), pa.int64())

    return F.arrow_udf(of_batch, "bigint")(text)


def _segments(fp: str = "fp") -> tuple[Column, Column]:
    return (F.shiftrightunsigned(fp, SEGMENT_BITS),
            F.col(fp).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))


def _ball(value: Column, bits: int) -> Column:
    """The value and its single-bit flips, as an array."""
    signed = [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(bits)]
    return F.array(value, *(value.bitwiseXOR(F.lit(m)) for m in signed))


def fingerprint_links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints in column ``fp``.

    Every link is between fingerprints at most two bits apart, and every two
    such fingerprints are connected by links.

    Both joins are sorted merges whatever the size: Spark takes a table after
    an explode to be as large as before it, and would send a list of 34 or 65
    rows a fingerprint through the driver.
    """
    first, second = _segments()
    cut = prints.select("fp", first.alias("s1"), second.alias("s2"))
    counts = cut.select(F.explode(F.array(
        F.struct(F.lit(1).alias("segment"), F.col("s1").alias("value")),
        F.struct(F.lit(2).alias("segment"), F.col("s2").alias("value")))).alias("k")
    ).groupBy("k.segment", "k.value").count()
    full = materialise(counts.where(F.col("count") > crowded))
    for number, name in ((1, "s1"), (2, "s2")):
        marks = full.where(F.col("segment") == number).select(
            F.col("value").alias(name), F.lit(True).alias(f"full{number}"))
        cut = cut.join(marks, name, "left")
    cut = materialise(cut.fillna(False, ["full1", "full2"]))

    # one table of both segments, so that one join serves both
    tables = cut.select("fp", F.explode(F.filter(F.array(
        F.struct(F.lit(1).alias("segment"), F.col("s1").alias("value"),
                 F.col("full1").alias("full")),
        F.struct(F.lit(2).alias("segment"), F.col("s2").alias("value"),
                 F.col("full2").alias("full"))), lambda x: ~x["full"])).alias("k")
    ).select("k.segment", "k.value", F.col("fp").alias("b"))
    probes = cut.select(F.col("fp").alias("a"), F.explode(F.concat(
        F.transform(_ball(F.col("s1"), SEGMENT_BITS), lambda v: F.struct(
            F.lit(1).alias("segment"), v.alias("value"))),
        F.array(F.struct(F.lit(2).alias("segment"), F.col("s2").alias("value"))),
    )).alias("k")).select("k.segment", "k.value", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = probes.join(tables.hint("merge"), ["segment", "value"]).where(
        (F.col("a") != F.col("b")) & near).select("a", "b")

    meeting = cut.where("full1 or full2").select(
        "fp", F.explode(_ball(F.col("fp"), 64)).alias("value"))
    least = meeting.groupBy("value").agg(F.min("fp").alias("least"))
    stars = meeting.join(least.hint("merge"), "value").where("fp <> least").select(
        F.col("fp").alias("a"), F.col("least").alias("b"))
    # members of one meeting value are within two bits of each other
    return pairs.union(stars)


def near_copies(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``fp, least, component, group_id`` of documents given as ``doc_id, fp``.

    One row per distinct fingerprint. ``least`` is its smallest doc_id, and
    ``group_id`` the smallest of its component; both null where no row has one.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(fingerprint_links(distinct.select("fp"), crowded))
    joined = distinct.join(
        groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("group_id"))
    return joined.join(least, "component")


def classes(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. Null, empty and blank texts share the
    fingerprint zero and are linked like any other; repeated rows are kept; a
    null doc_id is reported with its group. An empty table gives no rows.
    """
    prints = materialise(docs.select(
        "doc_id", fingerprint_column(F.col("text")).alias("fp")))
    return prints.join(
        near_copies(prints, crowded).select("fp", "group_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("group_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one member of each group, all columns as they are.

    The member with the smallest doc_id stays. Repeated rows of one doc_id and
    fingerprint count as one. A row without a doc_id stays only when no member
    of its group has one.
    """
    own = {name: _unused(docs, name) for name in ("_fp", "_id", "_no_id")}
    fp, at, no_id = own.values()
    printed = docs.withColumn(fp, fingerprint_column(F.col("text"))).withColumns(
        {at: F.coalesce("doc_id", F.lit(0)), no_id: F.col("doc_id").isNull()})
    prints = materialise(printed.select("doc_id", F.col(fp).alias("fp")))
    # two fingerprints of one group may carry its smallest id: one of them stays
    kept = near_copies(prints).where(
        F.col("least").eqNullSafe(F.col("group_id"))).groupBy("component").agg(
        F.min(F.struct("fp", F.col("group_id").alias("id"))).alias("k")).select(
        F.col("k.fp").alias(fp), F.coalesce("k.id", F.lit(0)).alias(at),
        F.col("k.id").isNull().alias(no_id))
    # the join and the removal of repeated rows share one shuffle of the texts
    return printed.join(kept, list(own.values()), "left_semi").dropDuplicates(
        list(own.values())).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name
