"""Merkle manifests against a tree built in plain Python, and against SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from classweave.llm import merkle, queries
from compare import compare, connect

COLUMNS = queries.MANIFEST_COLUMNS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = [*(row[c] for c in COLUMNS[:-1]), text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level):
    """Root, and the siblings of every node of the first level."""
    places, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for i, at in enumerate(places):
            run = level[at // 8 * 8:at // 8 * 8 + 8]
            paths[i].append((run[:at % 8], run[at % 8 + 1:]))
            places[i] = at // 8
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row, plain_leaf(row, row["text"])))
    names = sorted(groups, key=lambda n: b"" if n is None else b"=" + n.encode())
    for name in names:
        groups[name].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    built = {n: tree([leaf for _, leaf in groups[n]]) for n in names}
    if not names:
        return []
    root, over = tree([built[n][0] for n in names])
    out = []
    for name, above in zip(names, over):
        subroot, paths = built[name]
        for (row, leaf), path in zip(groups[name], paths):
            path = path + above
            shown = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = row["text"]
                shown = plain_leaf(row, text and "".join(
                    c.lower() if "A" <= c <= "Z" else c for c in text))
            for left, right in path:
                shown = h(*left, shown, *right)
            out.append((row["doc_id"], leaf, subroot, root,
                        h(*(d for left, right in path for d in (*left, *right))),
                        shown, shown == root))
    return sorted(out, key=str)


def run(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    found = queries.op11_merkle(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256",
                             "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 0.5) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, "
        "leaf string, pos double")


def some(draw, n, lang, start=0):
    return [(start + i, draw.choice(["s", None]), lang, i, draw.choice(["Ab é", "", None, "x" * 99]))
            for i in range(n)]


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 2], [512, 513, 1, 7],
                                   [1, 4097 + 512, 600]])
def test_equals_plain_tree(spark, monkeypatch, sizes):
    draw = random.Random(1)
    names = [None, "", "en", "é", "zz"]
    rows = [r for i, n in enumerate(sizes) for r in some(draw, n, names[i], i * 10_000)]
    docs = frame(spark, rows)
    assert run(spark, monkeypatch, docs) == plain([r.asDict() for r in docs.collect()])


def test_many_groups(spark, monkeypatch):
    """More groups than a block has nodes."""
    rows = [(i, None, f"l{i * 7919 % 700}", 1, "T") for i in range(900)]
    docs = frame(spark, rows)
    assert run(spark, monkeypatch, docs) == plain([r.asDict() for r in docs.collect()])


def test_odd_rows(spark, monkeypatch):
    """Null keys, repeated keys, equal rows, a very long text."""
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "A")] * 20 + [
        (5, "s", "en", 2, "B"), (-9, "s", "en", None, "Long " * 200_000), (3, None, None, 0, "")]
    docs = frame(spark, rows)
    assert run(spark, monkeypatch, docs) == plain([r.asDict() for r in docs.collect()])
    assert run(spark, monkeypatch, docs.where("doc_id < -100")) == []


def test_a_changed_leaf_fails(spark):
    docs = frame(spark, some(random.Random(2), 700, "en"))
    found = merkle.manifest(docs, COLUMNS, "lang", "doc_id", wrong=F.sha2(F.lit("x"), 256))
    assert found.where(merkle.fold(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0
    assert found.where(merkle.fold(F.col("path"), F.col("wrong")) == F.col("root")).count() == 0


def test_query_equals_sql(spark):
    for size in ("0.001", "0.01"):
        sf = f"/root/testdata/sf{size}"
        assert compare(queries.QUERIES["op11_merkle"](spark, sf), connect(sf),
                       queries.ORACLES["op11_merkle"]) is None
