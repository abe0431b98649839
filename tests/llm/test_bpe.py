"""Byte-level BPE against tiktoken, and the merge replay against its definition."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from classweave.llm import bpe, queries, ragged
from classweave.llm.ragged import piece_text, space_keys

PATTERN = public_tokenizers.PATTERN
RANKS_PATH = public_tokenizers.path(queries.BPE_RANKS)

ODD = [
    "", " ", "  ", "  a", "a  b", "a \n b", "\n\n x ", "a\n", "\na", " ab", "ab ",
    "aaaaaaa bbbbbbb", "=====   ====", "I'll don't  can't", "日本語 テキスト",
    "a\x1cb \x85c", "zzzz zzzz\r\n zz", "🙂🙂 🙂", "<|endoftext|> x", "x" * 5000,
    " " * 999 + "z", "12345 67 8,9", "\ta b\t c", "a\0 b", "\0", "x\u2003\u2003y \u2003z", "a\u00a0 b",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS_PATH)


@pytest.fixture(scope="module")
def tik(ranks):
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    draw = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "the", "ing", "'s", "1", "。", "--", "A"]
    return ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(n)]


def test_pieces_join_to_the_text():
    texts = ODD + random_texts(500, 1) + ["\0", "a\0 b", "\0\n c"]
    for text, keys in zip(texts, space_keys(pa.array(texts)).to_pylist()):
        assert "".join(map(piece_text, keys)) == text


def test_equals_tiktoken(ranks, tik):
    texts = ODD + random_texts(2000, 2)
    starts, ids = bpe.Encoder(ranks, PATTERN).encode(pa.array(texts))
    for text, low, high in zip(texts, starts, starts[1:]):
        assert ids[low:high].tolist() == tik.encode_ordinary(text)


def test_forgets_pieces_without_changing_ids(ranks, tik, monkeypatch):
    monkeypatch.setattr(ragged, "KNOWN_KEYS", 3)
    coder = bpe.Encoder(ranks, PATTERN)
    for text in random_texts(40, 3):
        assert coder.encode(pa.array([text]))[1].tolist() == tik.encode_ordinary(text)


def test_merges_that_depart_from_rank_order():
    """A vocabulary where a merge opens a pair of lower rank."""
    ranks = {bytes([b]): b + 100 for b in range(256)}
    ranks |= {b"ab": 400, b"abc": 3, b"cd": 401, b"aa": 402, b"aaa": 5, b"bc": 403}
    vocab = bpe.Vocabulary(ranks)
    draw = random.Random(4)
    words = ["".join(draw.choices("abcd", k=draw.randint(1, 9))).encode()
             for _ in range(800)]
    starts, ids = bpe.merge_words(words, vocab)
    for word, low, high in zip(words, starts, starts[1:]):
        whole = ranks.get(word)
        expected = [whole] if whole is not None else bpe.merge_word(word, ranks)
        assert ids[low:high].tolist() == expected


def test_columns_round_trip(spark, tik):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    shared = bpe.share_ranks(spark, RANKS_PATH)
    coded = docs.select("*", bpe.encode_column(
        shared, PATTERN, F.col("text")).alias("coded"))
    back = coded.select("*", bpe.decode_column(
        shared, PATTERN, F.col("coded")).alias("raw"))
    for row in back.collect():
        assert row.coded == tik.encode_ordinary(row.text or "")
        assert bytes(row.raw) == (row.text or "").encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    shared = bpe.share_ranks(spark, RANKS_PATH)
    assert docs.select(bpe.round_trip_column(
        shared, PATTERN, F.col("text"))).collect() == []


def test_query(spark, small, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(
        f"{small}/documents.parquet").collect()}
    found = queries.QUERIES["op1_byte_bpe"](spark, small).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for row in found:
        ids = tik.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        packed = np.array(ids, "<u4").tobytes()
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        raw = texts[row.doc_id].encode()
        assert row.decoded_sha256 == hashlib.sha256(raw).hexdigest()
