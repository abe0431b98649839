"""Language identification by language-bitmask n-gram filters.

One Bloom filter holds the character trigrams of every language at once: a slot
carries a bit per language, so one look-up at a trigram's slots, joined by AND,
gives all languages that hold it. A text's trigrams are counted per language,
the counts are corrected for the filter's false positives, and the largest
corrected share decides.

A trigram belongs to a language if at least ``MIN_SHARE`` of the language's
training documents contain it. Trigrams run over letters in lower case, with a
blank at either end of a word; every letter is the middle of one trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.ragged import distinct, offsets_of, text_blocks
from classweave.session import materialise

MIN_SHARE = 0.05
SLOT_BITS = 18
# the filter takes 2^SLOT_BITS x 8 bytes for each 64 languages
MAX_LANGUAGES = 512
WORD_BITS = 63
# a text with a smaller share of trigrams in its best language is rejected
MIN_COVERAGE = 0.25
BLOCK_CHARS = 500_000

UNKNOWN = "und"
RESULT_TYPE = "struct<lang:string,score:double,coverage:double>"

# Odd multipliers that spread a trigram over the slots.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and codes of all texts' trigrams, repeats included."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer(
        (" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = _letters()[code]
    code = np.where(letter, code, 0)
    middle = np.flatnonzero(letter)
    found = (code[middle - 1] << 42) | (code[middle] << 21) | code[middle + 1]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    # a text's characters start after the blank before it
    starts = np.arange(1, len(lowered) + 2) + offsets_of(sizes)
    return np.searchsorted(middle, starts), found


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    whole = codes.astype(np.uint64)
    return [((whole * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            for m in MULTIPLIERS]


class Filters:
    """The learned languages in order, and a row of slots per 63 languages."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        held = [(slots[i // WORD_BITS] >> (i % WORD_BITS)) & 1
                for i in range(len(languages))]
        self.false_rate = np.array(
            [h.mean() ** len(MULTIPLIERS) for h in held])

    def coverage(self, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Texts by languages: corrected share of trigrams held, 0 to 1."""
        sizes = np.maximum(np.diff(starts), 1)
        out = np.zeros((len(starts) - 1, len(self.languages)))
        at = slots_of(codes)
        for word, row in enumerate(self.slots):
            mask = row[at[0]]
            for more in at[1:]:
                mask &= row[more]
            first = word * WORD_BITS
            for i in range(first, min(first + WORD_BITS, len(self.languages))):
                hits = offsets_of((mask >> (i - first)) & 1)
                share = (hits[starts[1:]] - hits[starts[:-1]]) / sizes
                fp = self.false_rate[i]
                out[:, i] = np.clip((share - fp) / max(1 - fp, 1e-9), 0, 1)
        return out

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, float]]:
        """Language, score and coverage: the best share against the next best.

        No letter, or nothing learned: ``und`` and zero. Equal shares go to the
        language that sorts first.
        """
        starts, codes = trigrams(texts)
        shares = self.coverage(starts, codes)
        sizes = np.diff(starts)
        for n, row in zip(sizes.tolist(), shares):
            if not n or not len(row):
                yield UNKNOWN, 0.0, 0.0
                continue
            best = int(row.argmax())
            top = float(row[best])
            rest = float(np.delete(row, best).max(initial=0.0))
            yield (self.languages[best], top / (top + rest) if top else 0.0, top)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many documents of a language each trigram stands.

    The code -1 counts the documents themselves.
    """
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        row, found = 0, {}
        for block in text_blocks(batch.column("text"), BLOCK_CHARS):
            starts, codes = trigrams(block.to_pylist())
            for low, high in zip(starts.tolist(), starts[1:].tolist()):
                if high > low:
                    found.setdefault(langs[row], []).append(
                        np.append(distinct(codes[low:high]), -1))
                row += 1
        for lang, runs in found.items():
            grams, counts = np.unique(np.concatenate(runs), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams),
                 pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def _slot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = batch.column("number").to_numpy()
        at = slots_of(batch.column("gram").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(number // WORD_BITS, len(at))),
             pa.array(np.concatenate(at)),
             pa.array(np.tile(np.int64(1) << (number % WORD_BITS), len(at)))],
            names=["word", "slot", "bits"])


def fit(train: DataFrame, min_share: float = MIN_SHARE) -> Broadcast:
    """Learn the filters from ``lang`` and ``text`` of all rows of ``train``.

    Rows without a language or a letter teach nothing. Up to 512 languages;
    more raise ValueError. What reaches the driver and the executors is the
    filter, whose size is fixed by the number of languages.
    """
    spark = train.sparkSession
    counts = materialise(
        train.where(F.col("lang").isNotNull()).select("lang", "text")
        .mapInArrow(_document_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.where("gram = -1").select("lang", F.col("n").alias("documents"))
    languages = sorted(
        r.lang for r in totals.select("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    words = -(-len(languages) // WORD_BITS)
    slots = np.zeros((words, 1 << SLOT_BITS), np.int64)
    if languages:
        numbers = spark.createDataFrame(
            list(enumerate(languages)), "number long, lang string")
        held = (counts.where("gram <> -1").join(F.broadcast(totals), "lang")
                .where(F.col("n") >= F.col("documents") * min_share)
                .join(F.broadcast(numbers), "lang").select("number", "gram"))
        bits = held.mapInArrow(_slot_bits, "word long, slot long, bits long").groupBy(
            "word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[bits["word"].to_numpy(), bits["slot"].to_numpy()] = bits["bits"].to_numpy()
    return spark.sparkContext.broadcast(Filters(languages, slots))


def predict_column(model: Broadcast, text: Column) -> Column:
    """``lang``, ``score`` and ``coverage`` of each whole text; null is empty.

    ``score`` is the best language's share of trigrams over the sum of the two
    largest shares; ``coverage`` is the best share itself.
    """

    def predict(texts: pa.Array) -> pa.Array:
        rows = [row for block in text_blocks(texts, BLOCK_CHARS)
                for row in model.value.predict(block.to_pylist())]
        lang, score, coverage = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()),
             pa.array(coverage, pa.float64())], names=["lang", "score", "coverage"])

    return F.arrow_udf(predict, RESULT_TYPE)(text)


def keep_known(docs: DataFrame, model: Broadcast,
               min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Drop documents without a letter or in none of the learned languages."""
    guess = predict_column(model, F.col("text"))
    return docs.where(guess["coverage"] >= min_coverage)
