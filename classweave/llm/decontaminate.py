"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some token positions and ignore the others, so a hash
survives substitutions at ignored positions. Hashes of every position of every
document are joined with those of the benchmark; each hit names an alignment,
and the tokens around it are compared one by one.

A document overlaps an item if some ``WINDOW`` tokens of it (the whole item, if
that is shorter) agree with the item, place by place, in at least ``AGREE`` of
the tokens. The four masks meet every window with that many substitutions, for
all lengths from ``MIN_TOKENS`` to ``WINDOW``; a test tries them all.

The benchmark is the query set: items with the same tokens are taken once, long
items are cut into overlapping stretches, and the stretches are sent to the
executors in blocks of at most ``BLOCK_TOKENS`` tokens, one pass over the
documents for each ``BLOCKS_PER_PASS`` blocks. Nothing of the documents is
shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.ragged import KeyTable, held, ragged, text_blocks
from classweave.session import materialise

WINDOW = 20
AGREE = 0.8
MIN_TOKENS = 8
# 1 is a position that is looked at.
MASKS = ("11111", "10011011", "10100111", "110101001")

STRETCH_TOKENS = 4_096
BLOCK_TOKENS = 2_000_000
BLOCKS_PER_PASS = 4
FILTER_BITS = 20
# pairs of places with one seed, beyond which a text repeats itself
CROWDED_PAIRS = 100_000
BLOCK_CHARS = 2_000_000

HIT_TYPE = ("array<struct<item_id:bigint,doc_start:bigint,item_start:bigint,"
            "n_window:int,n_agree:int,item_ids:array<bigint>>>")

# Han, kana, Thai, Lao, Burmese and Khmer, which set no spaces between words
UNSPACED = ("\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
            "\u3041-\u309f\u30a1-\u30ff\u31f0-\u31ff\uff66-\uff9f"
            "\u0e00-\u0eff\u1000-\u109f\ua9e0-\ua9ff\uaa60-\uaa7f\u1780-\u17ff")
_TOKENS = re.compile(rf"(?=[^\W_])[{UNSPACED}]|(?:(?![{UNSPACED}])[^\W_])+").findall
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case; unspaced scripts by character."""
    return _TOKENS(text.lower())


def token_hashes(found: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode()) for t in found]


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One hash per start at which the whole mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at, looked in enumerate(mask):
        if looked == "1":
            total = (total ^ hashes[at:at + n]) * _STEP
            total ^= total >> np.uint64(29)
    return total


def needed(n_window: int) -> int:
    return math.ceil(AGREE * n_window - 1e-9)


class Block:
    """Stretches of items with a sorted table of their seed hashes."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, list[int]]]):
        """``rows``: item_id, place of the stretch in the item, token hashes, and
        the ids of all items with these tokens.
        """
        self.rows = rows
        self.tables = []
        for mask in MASKS:
            seeds = [seed_hashes(h, mask) for _, _, h, _ in rows]
            sizes = np.fromiter(map(len, seeds), np.int64, len(seeds))
            row = np.repeat(np.arange(len(rows)), sizes)
            place = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)])
            value = np.concatenate(seeds or [np.zeros(0, np.uint64)])
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((value[order], row[order], place[order], seen))

    def alignments(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (document, row, shift) met by a seed, all texts in one array.

        A shift is the item's place minus the document's. In a text that repeats
        itself many places meet many others on few shifts; those are found per
        shift, so that the work and memory follow the lengths, not the pairs.
        """
        found = []
        for mask, table in zip(MASKS, self.tables):
            value, row, place, seen = table
            seeds = seed_hashes(hashes, mask)
            at = np.flatnonzero(
                seen[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at) or not len(value):
                continue
            low = np.searchsorted(value, seeds[at], "left")
            count = np.searchsorted(value, seeds[at], "right") - low
            doc = np.searchsorted(starts, at, "right") - 1
            # a seed that runs over the end of its text belongs to none
            count[at + len(mask) > starts[doc + 1]] = 0
            met = np.bincount(doc, count, len(starts) - 1)
            for crowded in np.flatnonzero(met > CROWDED_PAIRS):
                own = (doc == crowded) & (count > 0)
                shifts = _crowded_shifts(
                    at[own] - starts[crowded], low[own], count[own], row, place)
                found.append(np.insert(shifts, 0, crowded, axis=1))
            count[met[doc] > CROWDED_PAIRS] = 0
            at, low, doc, count = (x[count > 0] for x in (at, low, doc, count))
            pick = _spread(low, count)
            found.append(np.stack([
                np.repeat(doc, count), row[pick],
                place[pick] - np.repeat(at - starts[doc], count)], axis=1))
        if not found:
            return np.zeros((0, 3), np.int64)
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        """(document, item_id, doc_start, item_start, window, agreeing, ids) verified.

        Once a whole window agrees, only earlier ones are looked for.
        """
        whole, until = None, 0
        for doc, row, shift in self.alignments(hashes, starts).tolist():
            item_id, offset, item, ids = self.rows[row]
            if whole != (doc, row):
                whole, until = (doc, row), starts[doc + 1] - starts[doc]
            first = max(0, -shift)
            last = min(until, len(item) - shift)
            window = min(WINDOW, len(item))
            if last - first < window:
                continue
            text = hashes[starts[doc] + first:starts[doc] + last]
            agree = np.cumsum(np.append(0, text == item[first + shift:last + shift]))
            counts = agree[window:] - agree[:-window]
            best = int(counts.argmax())
            if counts[best] == window:
                until = first + best + window - 1
            if counts[best] >= needed(window):
                yield (doc, item_id, first + best, offset + first + best + shift,
                       window, int(counts[best]), ids)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` on, ``count`` of them."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(
        ends - count, count) + np.repeat(low, count)


def _crowded_shifts(at: np.ndarray, low: np.ndarray, count: np.ndarray,
                    row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distinct (row, shift) of one text whose seeds stand at ``at``.

    A seed's entries in the table start at ``low``, which names the seed.
    """
    seed, which, times = np.unique(low, return_inverse=True, return_counts=True)
    entries = np.zeros(len(seed), np.int64)
    entries[which] = count
    pick = _spread(seed, entries)
    of = np.repeat(np.arange(len(seed)), entries)
    rows, which_row = np.unique(row[pick], return_inverse=True)
    pairs = np.bincount(which_row, times[of])
    order = np.lexsort((of, which_row))
    ends = np.searchsorted(which_row[order], np.arange(len(rows) + 1))
    places = np.split(at[np.argsort(which, kind="stable")], np.cumsum(times)[:-1])
    size, found = int(at.max()) + 1, []
    for number, (low, high) in enumerate(zip(ends[:-1], ends[1:])):
        own = order[low:high]
        if pairs[number] <= 4 * size:
            shifts = np.concatenate([place[pick[e]] - places[of[e]] for e in own])
        else:
            # one mark per shift: the text's places of a seed, turned round,
            # laid on from each of the item's places of it
            marks = np.zeros(size + int(place[pick[own]].max()) + 1, bool)
            last = None
            for e in own:
                if of[e] != last:
                    last = of[e]
                    turned = np.zeros(size, bool)
                    turned[size - 1 - places[last]] = True
                start = place[pick[e]]
                marks[start:start + size] |= turned
            shifts = np.flatnonzero(marks) - (size - 1)
        shifts = np.unique(shifts)
        found.append(np.stack([np.full(len(shifts), rows[number]), shifts], axis=1))
    return np.concatenate(found)


def blocks(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark's stretches in blocks of bounded size.

    Null texts and items of fewer than ``MIN_TOKENS`` tokens overlap nothing.
    Items with the same tokens are compared once, under the smallest item_id.
    """
    spark = benchmark.sparkSession

    def split(texts: pa.Array) -> pa.Array:
        return pa.array(
            [tokens(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    items = benchmark.select(
        "item_id", F.arrow_udf(split, "array<string>")(F.col("text")).alias("tokens")
    ).where(F.size("tokens") >= MIN_TOKENS).groupBy("tokens").agg(
        F.min("item_id").alias("item_id"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    step = STRETCH_TOKENS - WINDOW
    stretches = items.select(
        "item_id", "item_ids", "tokens", F.explode(F.sequence(
            F.lit(0), F.greatest(F.size("tokens") - WINDOW - 1, F.lit(0)),
            F.lit(step))).alias("offset")).select(
        "item_id", "item_ids", "offset",
        F.slice("tokens", F.col("offset") + 1, STRETCH_TOKENS).alias("tokens"))
    total = stretches.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_blocks = max(1, -(-total // (BLOCK_TOKENS // 2)))
    stretches = materialise(stretches.withColumn(
        "block", F.pmod(F.xxhash64("tokens"), F.lit(n_blocks))))
    found = []
    for number in range(n_blocks):
        rows = stretches.where(F.col("block") == number).orderBy(
            "item_id", "offset").collect()
        found.append(spark.sparkContext.broadcast(Block([
            (r.item_id, r.offset, np.array(token_hashes(r.tokens), np.uint64), r.item_ids)
            for r in rows])))
    return found


def _token_table() -> KeyTable:
    """One table of hashed words per worker."""
    return held("token hashes", lambda: KeyTable(lambda keys: ragged(
        (token_hashes(tokens(k)) for k in keys), np.uint64), np.uint64))


def hits_column(shared: list[Broadcast], text: Column) -> Column:
    """The best overlap of each text with each item; null and empty have none."""

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for block in text_blocks(texts, BLOCK_CHARS):
            starts, hashes = _token_table().read(pc.utf8_split_whitespace(block))
            best: list[dict] = [{} for _ in block]
            met: dict[tuple, set] = {}
            for part in shared:
                for doc, item, *rest, ids in part.value.overlaps(hashes, starts):
                    met.setdefault((doc, item), set()).update(ids)
                    old = best[doc].get(item)
                    if old is None or (-rest[3], rest[0]) < (-old[3], old[0]):
                        best[doc][item] = rest
            out += [[dict(zip(("item_id", "doc_start", "item_start", "n_window",
                               "n_agree", "item_ids"),
                              (item, *rest, sorted(met[doc, item]))))
                     for item, rest in sorted(
                         hits.items(), key=lambda x: (x[0] is None, x[0] or 0))]
                    for doc, hits in enumerate(best)]
        return pa.array(out, pa.list_(pa.struct([
            ("item_id", pa.int64()), ("doc_start", pa.int64()),
            ("item_start", pa.int64()), ("n_window", pa.int32()),
            ("n_agree", pa.int32()),
            ("item_ids", pa.list_(pa.int64()))])))

    return F.arrow_udf(find, HIT_TYPE)(text)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per overlapping pair: ``doc_id``, ``item_id`` and its best window.

    Places count tokens from zero. Repeated documents are all reported. Items with
    the same tokens make one row; ``item_ids`` has all their ids.
    """
    shared = blocks(benchmark)
    passes = [docs.select("doc_id", F.explode(hits_column(
        shared[i:i + BLOCKS_PER_PASS], F.col("text"))).alias("hit")).select(
        "doc_id", "hit.*") for i in range(0, len(shared), BLOCKS_PER_PASS)]
    return reduce(DataFrame.union, passes).withColumn(
        "overlap", F.col("n_agree") / F.col("n_window"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, all columns as they are."""
    shared = blocks(benchmark)
    for i in range(0, len(shared), BLOCKS_PER_PASS):
        docs = docs.where(F.size(hits_column(
            shared[i:i + BLOCKS_PER_PASS], F.col("text"))) == 0)
    return docs
