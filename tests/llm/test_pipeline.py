"""The pipeline's stages on planted rows, and on the tables against brute force."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from classweave.llm import bpe, decontaminate, queries
from test_simhash import plain_fingerprint
from brute import reach

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    docs, found = queries.table(spark, SF, "documents"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "tokens":
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        found[name] = docs.collect()
    return found


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language", "near_copies", "benchmarks", "tokens"]


def test_near_copies_equal_brute_force(kept):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in kept["language"]}
    least = reach(sorted(docs), lambda a, b: (docs[a] ^ docs[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted(set(least.values()))


def test_benchmarks_are_gone(spark, kept):
    items = queries.table(spark, SF, "benchmark").collect()
    runs = {tuple(w[i:i + 16]) for r in items for w in [decontaminate.tokens(r.text)]
            for i in range(len(w) - 15)}
    holding = {r.doc_id for r in kept["near_copies"]
               for w in [decontaminate.tokens(r.text)]
               if any(tuple(w[i:i + 16]) in runs for i in range(len(w) - 15))}
    left = {r.doc_id for r in kept["benchmarks"]}
    assert holding and not holding & left
    assert len(left) > 0.8 * len(kept["near_copies"])


def test_toxic_go_and_clean_stay(spark, kept):
    truth = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    left = {r.doc_id for r in kept["toxicity"]}
    clean = [i for i, t in truth.items() if not t]
    toxic = [i for i, t in truth.items() if t]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)
    assert sum(i in left for i in toxic) <= 0.4 * len(toxic)
    assert len(kept["language"]) >= 0.99 * len(kept["toxicity"])


def test_tokens(kept):
    ranks = bpe.read_ranks(public_tokenizers.path(queries.BPE_RANKS))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in kept["benchmarks"]}
    assert {r.doc_id for r in kept["tokens"]} == set(texts)
    for r in kept["tokens"]:
        assert r.ids == tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, kept):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.ids_sha256 for r in rows) == sorted(
        r.ids_sha256 for r in kept["tokens"])


def test_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing columns and an empty table pass every stage."""
    for name in ("labels", "benchmark"):
        queries.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [r.asDict() for r in queries.table(spark, SF, "documents").limit(300).collect()]
    odd = [dict(rows[0], doc_id=None), dict(rows[0]), dict(rows[1], text=None),
           dict(rows[2], text=""), dict(rows[3], lang=None, source=None, n_chars=None)]
    docs = spark.createDataFrame(
        [tuple(r.values()) + ("x", 0.5) for r in rows + odd],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "_fp string, score double")
    for docs in (docs, docs.where("doc_id < -1")):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(
                (out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
        assert not docs.where("doc_id is null").count()
