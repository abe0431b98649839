"""Spaced seeds against all substitution patterns and all alignments."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from classweave.llm import decontaminate as d
from classweave.llm import queries


@pytest.mark.parametrize("n", range(d.MIN_TOKENS, d.WINDOW + 1))
def test_masks_meet_every_pattern(n):
    looked = [[i for i, c in enumerate(m) if c == "1"] for m in d.MASKS]
    places = [{s + i for i in own} for own, m in zip(looked, d.MASKS)
              for s in range(n - len(m) + 1)]
    for wrong in itertools.combinations(range(n), n - d.needed(n)):
        assert any(not p.intersection(wrong) for p in places)


def plain(doc, items):
    """Best agreeing count per item over all alignments and windows."""
    words, found = d.tokens(doc or ""), {}
    for item_id, text in items:
        item = d.tokens(text or "")
        if len(item) < d.MIN_TOKENS:
            continue
        window = min(d.WINDOW, len(item))
        for i in range(len(words) - window + 1):
            for j in range(len(item) - window + 1):
                same = sum(a == b for a, b in zip(words[i:i + window], item[j:j + window]))
                if same >= d.needed(window):
                    found[item_id] = max(found.get(item_id, 0), same)
    return found


def made(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 7, 8, 11, 19, 20, 45]))))
             for i in range(30)]
    docs = []
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(0, 50))
        for _ in range(draw.randint(0, 2)):
            part = draw.choice(items)[1].split()
            low = draw.randint(0, max(0, len(part) - 25))
            part = part[low:low + draw.randint(8, 40)]
            part = [draw.choice(vocabulary) if draw.random() < 0.17 else w for w in part]
            at = draw.randint(0, len(words))
            words[at:at] = part
        docs.append((i, draw.choice([" ", "\n", ", "]).join(words).title()))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_alignments(spark, seed, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(d, "BLOCKS_PER_PASS", 1)
    docs, items = made(seed)
    rows = d.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = {(i, item): n for i, text in docs for item, n in plain(text, items).items()}
    assert {(r.doc_id, r.item_id): r.n_agree for r in rows} == expected
    assert len(rows) == len(expected) > 0


def test_long_items_are_cut(monkeypatch, spark):
    monkeypatch.setattr(d, "STRETCH_TOKENS", 50)
    words = [f"x{i}" for i in range(333)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame(
        [(s, " ".join(words[s:s + 20])) for s in range(314)], "doc_id long, text string")
    rows = d.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.item_start, r.n_agree) for r in rows) == [
        (s, s, 20) for s in range(314)]


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, text, "x"), (None, text.upper(), "y"), (3, None, "z"), (4, "", None),
         (1, text, "x"), (6, "filler " * 300_000 + text, "long"), (7, "clean text", "ok")],
        "doc_id long, text string, item_id string")
    items = spark.createDataFrame(
        [(10, text), (11, text.replace(" ", ", ")), (12, None), (13, "too short"), (14, "")],
        "item_id long, text string")
    rows = d.overlaps(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.doc_start) for r in rows) == [
        (0, 10, 0), (1, 10, 0), (1, 10, 0), (6, 10, 300_000)]
    kept = d.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    assert d.overlaps(docs, items.where("item_id < 0")).count() == 0
    assert d.overlaps(docs.where("doc_id < 0"), items).count() == 0


def test_query(spark, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    runs = {tuple(w[i:i + 8]) for r in items for w in [d.tokens(r.text)]
            for i in range(len(w) - 7)}
    holding = {r.doc_id for r in docs for w in [d.tokens(r.text)]
               if any(tuple(w[i:i + 8]) in runs for i in range(len(w) - 7))}
    found = queries.QUERIES["op2_decontamination"](spark, small).collect()
    assert {r.doc_id for r in found} == holding != set()


def all_shifts(block, hashes, starts):
    """Every place against every place."""
    found = set()
    for mask in d.MASKS:
        for doc, (low, high) in enumerate(zip(starts, starts[1:])):
            own = d.seed_hashes(hashes[low:high], mask).tolist()
            for row, (_, _, item, _) in enumerate(block.rows):
                for q, seed in enumerate(d.seed_hashes(item, mask).tolist()):
                    found |= {(doc, row, q - p) for p, s in enumerate(own) if s == seed}
    return sorted(found)


def test_repeats_meet_the_same_places(monkeypatch):
    """Runs, short cycles and two-letter noise, with every text counted as crowded."""
    draw = np.random.default_rng(5)
    texts = [np.full(90, 7), np.tile([1, 2], 40), np.tile([1, 2, 3, 4, 5], 12),
             draw.integers(0, 2, 120), draw.integers(0, 40, 60), np.zeros(0, int)]
    items = [(i, 0, t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), [i])
             for i, t in enumerate([np.full(30, 7), np.tile([2, 1], 30), *texts[2:5]])]
    block = d.Block(items)
    hashes = np.concatenate(texts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for pairs in (0, 50, 10**9):
        monkeypatch.setattr(d, "CROWDED_PAIRS", pairs)
        assert sorted(map(tuple, block.alignments(hashes, starts).tolist())) == all_shifts(
            block, hashes, starts)


def test_long_repeats_take_little(spark):
    """An item and a document of 10,000 equal words, in seconds and megabytes."""
    word = np.full(10_000, 12345, np.uint64)
    block = d.Block(
        [(1, at, word[at:at + d.STRETCH_TOKENS], [1]) for at in (0, 4076, 8152)])
    begin = time.process_time()
    found = list(block.overlaps(word, np.array([0, len(word)])))
    assert time.process_time() - begin < 2
    tracemalloc.start()
    block.alignments(word, np.array([0, len(word)]))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert found[0][2] == 9980 or min(f[2] for f in found) == 0
    docs = spark.createDataFrame([(5, "zero " * 10_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "zero " * 10_000)], "item_id long, text string")
    row = d.overlaps(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.n_agree) for r in row] == [(5, 1, 0, 20)]
