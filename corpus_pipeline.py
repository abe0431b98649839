"""The corpus pipeline: toxicity, language, near copies, benchmarks, tokens.

Each stage reads what its predecessor kept, written as Parquet. All but the last
return the columns of ``documents`` as they are:

- ``toxicity`` drops documents predicted to be toxic, learned from all labels of
  the documents that are there;
- ``language`` drops documents without a letter or in none of the languages
  learned from the documents that name one;
- ``near_copies`` keeps the member with the smallest doc_id of each group of texts
  whose SimHash fingerprints over three words in a row are linked by two or fewer
  differing bits;
- ``benchmarks`` drops documents that overlap a benchmark item;
- ``tokens`` returns ``doc_id, n_tokens, ids`` and the digests of the ids and of
  the bytes they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classweave.llm import bpe, decontaminate, langid, simhash, toxicity
from classweave.llm.queries import BPE_RANKS, table
from classweave.session import materialise


# what goes to a Python worker at once; results do not depend on it
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
         "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def bound_batches(spark: SparkSession) -> None:
    """Keep the workers' memory small beside long texts, for this session.

    A stage's result is read after the stage returns, so the setting stays.
    """
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return toxicity.keep_clean(
        docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame,
                          sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.keep_one(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    ranks = bpe.share_ranks(spark, public_tokenizers.path(BPE_RANKS))
    done = bpe.round_trip_column(
        ranks, public_tokenizers.PATTERN, F.col("text"), with_ids=True)
    return docs.select("doc_id", done.alias("_done")).select("doc_id", "_done.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("benchmarks", drop_benchmarks),
    ("tokens", encode),
]

# learned models, fingerprints and merges have no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
