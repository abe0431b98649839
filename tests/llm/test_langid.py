"""Language filters against plain sets, and held-out accuracy."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from classweave.llm import langid, queries


def plain_trigrams(text):
    found = []
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = " " + word + " "
        found += [word[i:i + 3] for i in range(len(word) - 2)]
    return found


def unpack(code):
    return "".join(chr(c) if (c := code >> s & 0x1FFFFF) else " " for s in (42, 21, 0))


TEXTS = ["", "a", "Ab cd", "1 2 ..", "Éa_b\nc", "日本 x", "it's", " lead", "end "]


def test_trigrams():
    starts, codes = langid.trigrams(TEXTS)
    for text, low, high in zip(TEXTS, starts, starts[1:]):
        assert [unpack(int(c)) for c in codes[low:high]] == plain_trigrams(text)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()


def test_equals_plain_sets(spark, rows):
    train = [(r.text, r.lang) for r in rows[::2]]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string")).value
    seen, documents = defaultdict(Counter), Counter()
    for text, lang in train:
        if grams := set(plain_trigrams(text)):
            seen[lang].update(grams)
            documents[lang] += 1
    held = {k: {g for g, n in seen[k].items() if n >= langid.MIN_SHARE * documents[k]}
            for k in seen}
    assert model.languages == sorted(held)
    texts = [r.text for r in rows[1::2]]
    for text, (lang, score, coverage) in zip(texts, model.predict(texts)):
        grams = plain_trigrams(text)
        shares = {k: sum(g in held[k] for g in grams) / len(grams) for k in held}
        best = max(sorted(shares), key=shares.get)
        # the filter's own false positives are corrected on average only
        assert shares[lang] >= shares[best] - 0.02
        assert abs(coverage - shares[lang]) < 0.03 and 0 <= score <= 1


def test_many_languages(spark):
    train = [(f"{chr(0x4E00 + i) * 3} x", f"l{i:03d}") for i in range(130)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string")).value
    found = [lang for lang, _, _ in model.predict([t for t, _ in train])]
    assert found == [lang for _, lang in train]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 1.0), (2, None, "en", 2.0), (3, "", None, None),
         (None, "le chat et le chien", "fr", 3.0), (None, "123 ...", "de", 4.0),
         (1, "the cat and the dog", "en", 1.0), (6, "the " * 200_000, None, 0.0)],
        "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    found = docs.select("*", langid.predict_column(model, F.col("text")).alias("g")).collect()
    assert [r.g.lang for r in found] == ["en", "und", "und", "fr", "und", "en", "en"]
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, None, 1, 6]
    none = docs.where("doc_id > 99")
    assert langid.fit(none).value.languages == []
    assert langid.keep_known(none, model).count() == 0
    assert next(langid.fit(none).value.predict(["words"])) == ("und", 0.0, 0.0)


def test_query(spark, rows):
    found = queries.QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in rows}
    assert sorted(r.doc_id for r in found) == sorted(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
