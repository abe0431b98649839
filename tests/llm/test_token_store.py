"""Token files: ids as the library gives them, order, single documents, damage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from classweave.llm import queries, token_store
from classweave.llm.shared_files import open_folder
from classweave.session import new_folder
from test_bpe import ODD, random_texts

PATH = public_tokenizers.path(queries.STORE_TOKENIZER)
SPEC = open(PATH, encoding="utf-8").read()
PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_library():
    low = "".join(map(chr, range(0x250)))
    texts = ODD + random_texts(1500, 8) + ["a<|endoftext|>b <|endoftext|> c", low, " ".join(low)]
    assert token_store.cuts_are_safe(SPEC)
    starts, ids = token_store.Encoder(SPEC).encode(pa.array(texts))
    for text, low, high in zip(texts, starts, starts[1:]):
        assert ids[low:high].tolist() == plain_ids(text)[:-1]


def test_other_tokenizers_encode_whole_texts():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    assert not token_store.cuts_are_safe(spec)
    tokenizer = Tokenizer.from_str(spec)
    starts, ids = token_store.Encoder(spec).encode(pa.array(["Some words", "", "x\n y"]))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in ["Some words", "", "x\n y"]]


ROWS = [(7, "seven words stand here", 1), (3, None, 2), (5, "", 3), (None, "no id", 4),
        (5, "five again", 5), (7, "seven words stand here", 6), (1, "é 日本 " * 50_000, 7)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start int").repartition(3)
    folder = new_folder(spark, "t")
    files = token_store.write_store(docs, SPEC, folder)
    rows = sorted(token_store.read_store(files, folder).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text, _) in zip(rows, order, strict=True):
        ids = plain_ids(text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = docs.where("doc_id < 0")
    files = token_store.write_store(none, SPEC, folder)
    assert token_store.read_store(files, folder).count() == 0


def test_reads_one_document_alone(spark, small):
    docs = queries.table(spark, small, "documents")
    folder = new_folder(spark, "t")
    files = token_store.write_store(docs, SPEC, folder).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    system, base = open_folder(folder)

    def dictionary_of(digest):
        with system.open_input_stream(
                token_store.dictionary_file(base, digest), compression=None) as s:
            return s.read()

    draw = random.Random(1)
    for file in files:
        with system.open_input_file(open_folder(file.file)[1]) as source:
            reader = token_store.FileReader(source, dictionary_of)
            assert len(reader.index) == file.documents
            row = draw.randrange(file.documents)
            doc_id = int(reader.index[row]["doc_id"])
            assert reader.ids(row).tolist() == plain_ids(texts[doc_id])
            source.seek(0)
            with pytest.raises(ValueError):
                token_store.FileReader(source, lambda digest: b"another dictionary")


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op6_token_store"](spark, small).collect()}
    start = 0
    for doc_id in sorted(docs):
        ids, row = plain_ids(docs[doc_id]), rows.pop(doc_id)
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not rows
