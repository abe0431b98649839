"""SimHash groups against all pairs, with crowded tables and odd rows."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from brute import reach
from classweave.llm import queries, simhash
from classweave.llm.components import components


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(
        b"\x0b", b" ").split() if w]
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64)
               if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("text", [
    "", "  \t\n", "One", "Two words", "a B c", "Éa É é x\xa0y z", "a b c " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == signed(plain_fingerprint(text))


def planted(n, seed):
    """Fingerprints in clusters of few bits around some centres."""
    draw = random.Random(seed)
    found = set()
    while len(found) < n:
        value = draw.getrandbits(64)
        for _ in range(draw.randint(1, 40)):
            other = value
            for _ in range(draw.randint(0, 4)):
                other ^= 1 << draw.randrange(64)
            found.add(signed(other))
            if draw.random() < 0.3:
                value = other
    return sorted(found)


@pytest.mark.parametrize("crowded", [1, 4, 1000])
def test_groups_equal_all_pairs(spark, crowded):
    prints = planted(400, 5)
    expected = reach(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    frame = spark.createDataFrame([(p, p) for p in prints], "doc_id long, fp long")
    rows = simhash.near_copies(frame, crowded).collect()
    assert {r.fp: r.group_id for r in rows} == expected
    assert len(rows) == len(prints)


@pytest.mark.parametrize("threshold", ["10m", "1g"])
def test_exploded_tables_are_not_broadcast(spark, threshold):
    """A list of a Hamming ball's values is many times what Spark takes it for."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    prints = spark.createDataFrame([(p,) for p in planted(400, 5)], "fp long")
    before = spark.conf.get(name)
    spark.conf.set(name, threshold)
    try:
        links = simhash.fingerprint_links(prints, crowded=4)
        assert links.count()
        plan = links._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("SortMergeJoin") >= 2 and "Broadcast" not in plan


def test_components(spark):
    draw = random.Random(6)
    chain = [(i, i + 1) for i in range(200, 240)]
    pairs = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(70)]
    links = chain + pairs + pairs[:5] + [(7, 7)]
    linked = {frozenset(p) for p in links}
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    expected = reach(nodes, lambda a, b: frozenset((a, b)) in linked)
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    rows = components(frame).collect()
    assert {r.node: r.component for r in rows} == expected
    assert len(rows) == len(nodes)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [
    (5, "some words that stand here", "x"), (3, "some words that stand here", "y"),
    (3, "some words that stand here", "y"), (9, None, "z"), (8, "", "z"), (7, " \n", None),
    (None, "nothing like it at all", "q"), (None, "another one without an id", "q"),
    (4, "Some WORDS that stand here", "x"), (4, "but one more text of id four", "x"),
]


def test_classes_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fp string")
    rows = simhash.classes(docs).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    same = f"{plain_fingerprint(ROWS[0][1]):016x}"
    assert found[(5, same)] == found[(3, same)] == found[(4, same)] == 3
    assert found[(9, "0" * 16)] == found[(8, "0" * 16)] == 7


def test_keep_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([
        ROWS[1], ROWS[5], ROWS[6], ROWS[7], ROWS[9]], key=str)
    assert simhash.keep_one(docs.where("doc_id < 0")).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    expected = reach(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = queries.QUERIES["op8_simhash"](spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", expected[i]) for i in prints}
