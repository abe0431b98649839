"""Benchmark items in scripts that set no spaces."""

import pytest

from classweave.llm import decontaminate as d

ITEMS = [(1, "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"),
         (2, "いろはにほへとちりぬるをわかよたれそつねならむ"),
         (3, "กรงทองของเขาวางอยบนตนไมขางบาน"),
         (4, "seven words and one more make eight 日本")]


@pytest.mark.parametrize("text, expected", [
    ("中文 and English2", ["中", "文", "and", "english2"]),
    ("カタカナa_b", ["カ", "タ", "カ", "ナ", "a", "b"]),
    ("Élan vital, 42", ["élan", "vital", "42"]), ("、。", []), ("", [])])
def test_tokens(text, expected):
    assert d.tokens(text) == expected


def test_clauses_match_with_substitutions(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(i, f"前文、{text[:5]}X{text[6:]}。") for i, text in ITEMS[:3]]
    docs.append((9, "今日は天気がいいから散歩しましょう"))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = d.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (2, 2), (3, 3)]
    assert [r.doc_id for r in d.keep_clean(docs, items).collect()] == [9]
