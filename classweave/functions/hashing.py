"""Sampling by a hash of the row key.

The choice depends on the key and seed alone, so the same rows are taken under
any partitioning, on any retry and in any SQL engine that has md5.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2**32
# holds a null's place, so that it does not hash like a shorter key
NULL_KEY = "\x00"


def _key_text(key: Sequence[str], seed: int) -> Column:
    return F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)) for c in key),
        F.lit(str(seed))
    )


def hash_hex(key: Sequence[str], seed: int) -> Column:
    """First 32 bits of the key's md5, as eight hex digits."""
    return F.substring(F.md5(_key_text(key, seed)), 1, 8)


def hash_number(key: Sequence[str], seed: int) -> Column:
    """The same 32 bits as a long in [0, 2^32)."""
    return F.conv(hash_hex(key, seed), 16, 10).cast("long")


def hash_below(key: Sequence[str], seed: int, fraction: float) -> Column:
    """True for about ``fraction`` of the keys.

    Eight hex digits order like the numbers they write, so the test compares
    text and skips the base conversion.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction {fraction} is outside [0, 1]")
    bound = math.ceil(fraction * HASH_SPACE)
    if bound >= HASH_SPACE:
        return F.lit(True)
    if bound <= 0:  # spares every row the digest
        return F.lit(False)
    return hash_hex(key, seed) < F.lit(f"{bound:08x}")


def hash_between(key: Sequence[str], seed: int, lower: float,
                 upper: float) -> Column:
    return hash_below(key, seed, upper) & ~hash_below(key, seed, lower)


def fold_number(key: Sequence[str], seed: int, folds: int) -> Column:
    return (hash_number(key, seed) % F.lit(folds)).cast("int")
