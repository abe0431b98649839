"""Class balancing, splitting and folds, all by a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.functions.hashing import (
    fold_number,
    hash_below,
    hash_between,
)

# The sampling seed and the share of rows kept for training.
SEED = 42
TRAIN_SHARE = 0.8

SPLIT_SEED = 43
FOLD_SEED = 44


@dataclass(frozen=True)
class Balance:
    majority: float
    majority_count: int
    minority: float
    minority_count: int

    @property
    def ratio(self) -> float:
        return self.minority_count / self.majority_count


def measure_balance(df: DataFrame, label: str = "label") -> Balance:
    """Count both classes in one job. Equal counts are ordered by label."""
    counted = (
        df.filter(F.col(label).isNotNull()).groupBy(label).count()
        .limit(3).collect()
    )
    return balance_of({r[label]: r["count"] for r in counted})


def balance_of(counts: dict[float, int]) -> Balance:
    held = [(n, value) for value, n in counts.items() if n]
    if len(held) != 2:
        raise ValueError(f"balancing needs two classes, found {len(held)}")
    (few, minority), (many, majority) = sorted(held)
    return Balance(majority, many, minority, few)


def _kept(balance: Balance, key: Sequence[str], label: str, seed: int) -> Column:
    return (F.col(label) == balance.majority) & hash_below(
        key, seed, balance.ratio
    )


def majority_sample(df: DataFrame, balance: Balance, key: Sequence[str],
                    label: str = "label", seed: int = SEED) -> DataFrame:
    return df.filter(_kept(balance, key, label, seed))


def minority_rows(df: DataFrame, balance: Balance,
                  label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == balance.minority)


def balance_classes(df: DataFrame, key: Sequence[str], label: str = "label",
                    seed: int = SEED,
                    balance: Balance | None = None) -> DataFrame:
    """The minority whole and a sample of the majority of about its size.

    One filter over one scan gives the rows a union of the two would.
    """
    balance = balance or measure_balance(df, label)
    return df.filter(
        (F.col(label) == balance.minority) | _kept(balance, key, label, seed)
    )


def balanced_union(df: DataFrame, key: Sequence[str], label: str = "label",
                   seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(balanced, sampled majority, minority), the parts joined by name."""
    balance = measure_balance(df, label)
    majority = majority_sample(df, balance, key, label, seed)
    minority = minority_rows(df, balance, label)
    return majority.unionByName(minority), majority, minority


def split(df: DataFrame, key: Sequence[str],
          shares: Sequence[float] = (TRAIN_SHARE, 1 - TRAIN_SHARE),
          seed: int = SPLIT_SEED) -> list[DataFrame]:
    """Disjoint parts that together hold every row."""
    total = sum(shares)
    edges = [0.0]
    for share in shares:
        edges.append(edges[-1] + share / total)
    edges[-1] = 1.0
    return [
        df.filter(hash_between(key, seed, lower, upper))
        for lower, upper in zip(edges, edges[1:])
    ]


def with_fold(df: DataFrame, key: Sequence[str], folds: int,
              seed: int = FOLD_SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, fold_number(key, seed, folds))
