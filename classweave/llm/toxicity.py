"""Toxicity scores from the nearest labelled examples.

Terms are words whose use differs between the labels. Each labelled example is a
TF-IDF vector over these terms; a document is scored by the ``NEIGHBOURS``
examples of highest cosine, found exactly with a block-max inverted index:
examples stand in blocks, each block keeps the largest weight of every term, the
blocks are read from the highest bound down, and reading stops when no unread
block can beat the neighbours held. Votes are weighted by nearness and mapped to
probabilities learned on a third of the examples that had no part in choosing
the terms, each left out of its own vote.

What is fitted on labels uses at most ``CLASS_ROWS`` examples of each label,
taken by a hash; how often a term is used is counted over all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.ragged import KeyTable, held, ragged, text_blocks

CLASS_ROWS = 5_000
MAX_TERMS = 2_000
MIN_ROWS = 4
MIN_CHI2 = 24.0  # one in a million by chance, as very many words are tried
MIN_LIFT = 3.0
NEIGHBOURS = 15
BLOCK = 64
SCORE_STEPS = 20
THRESHOLD = 0.5
BLOCK_CHARS = 1_000_000
# distinct bags of terms whose scores a worker remembers
KNOWN_BAGS = 20_000

RESULT_TYPE = ("struct<score:double,neighbours:array<struct<"
               "doc_id:bigint,toxic:int,cosine:double>>>")

_WORDS = re.compile(r"[^\W\d_]+").findall


def labelled(labels: DataFrame, rows: int = CLASS_ROWS) -> DataFrame:
    """``doc_id, toxic, weight, judge`` of at most ``rows`` documents of each label.

    ``judge`` marks the third kept for calibration. The rows are those with the smallest hash of their id. A document with
    several labels has the largest; null labels and ids are left out. The weight
    is how many labelled documents a row stands for.
    """
    single = labels.where("toxic is not null and doc_id is not null").groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in single.groupBy("toxic").agg(
        F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    parts = [
        single.where(F.col("toxic") == kind)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .withColumn("weight", F.lit(max(1.0, totals.get(kind, 0) / rows)))
        for kind in (0, 1)]
    return parts[0].union(parts[1]).withColumn(
        "judge", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)


class TermCounter:
    """Counts the terms of texts; other words cost one look-up."""

    def __init__(self, terms: list[str]):
        numbers = {t: i for i, t in enumerate(terms)}
        self.table = KeyTable(
            lambda keys: ragged(
                ([numbers[w] for w in _WORDS(k.lower()) if w in numbers] for k in keys),
                np.int32), np.int32)
        # the scores of bags met, see term_counter
        self.scored: dict[tuple, tuple] = {}

    def count(self, texts: pa.Array) -> Iterator[Counter]:
        starts, found = self.table.read(pc.utf8_split_whitespace(texts))
        starts = starts.tolist()
        for low, high in zip(starts, starts[1:]):
            yield Counter(found[low:high].tolist())


def term_counter(terms: list[str], model: str = "") -> TermCounter:
    """One counter per worker, with the scores of one model."""
    key = ("terms", xxhash.xxh64_hexdigest("\n".join(terms)), model)
    return held(key, lambda: TermCounter(terms))


class Index:
    """Block-max inverted index over the distinct example vectors."""

    def __init__(self, idf: np.ndarray, bags: list[tuple], votes: np.ndarray,
                 owners: list[int]):
        """``votes``: weight of clean and of toxic rows of each bag."""
        self.idf, self.votes, self.owners = idf, votes, owners
        vectors = [self.vector(bag) for bag in bags]
        # like vectors stand together, so that a block's bounds are tight
        order = sorted(range(len(bags)), key=lambda i: sorted(
            ((-w, t) for t, w in vectors[i].items()))[:3])
        self.votes = votes[order]
        self.owners = [owners[i] for i in order]
        self.place = {bags[i]: at for at, i in enumerate(order)}
        n_blocks = -(-len(order) // BLOCK)
        self.bounds = np.zeros((len(idf), n_blocks))
        self.postings: dict[tuple[int, int], tuple[list, list]] = {}
        for at, i in enumerate(order):
            block = at // BLOCK
            for term, weight in vectors[i].items():
                rows, weights = self.postings.setdefault((block, term), ([], []))
                rows.append(at % BLOCK)
                weights.append(weight)
                self.bounds[term, block] = max(self.bounds[term, block], weight)
        self.postings = {k: (np.array(r), np.array(w))
                         for k, (r, w) in self.postings.items()}

    def vector(self, bag: tuple) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in bag}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def nearest(self, bag: tuple, skip: int = -1,
                k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k example vectors of highest cosine above zero, best first.

        Equal cosines go to the smaller place. ``skip`` is left out.
        """
        query = self.vector(bag)
        if not query or not self.bounds.size:
            return []
        terms = list(query)
        bound = np.array([query[t] for t in terms]) @ self.bounds[terms]
        held: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            # a hair of slack: bounds and scores are summed in different order
            if bound[block] <= 0 or (
                    len(held) == k and bound[block] < held[0][0] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for term in terms:
                if (found := self.postings.get((block, term))) is not None:
                    scores[found[0]] += query[term] * found[1]
            for row in np.flatnonzero(scores > 0).tolist():
                at = block * BLOCK + row
                entry = (round(float(scores[row]), 12), -at)
                if at == skip:
                    continue
                if len(held) < k:
                    heapq.heappush(held, entry)
                elif entry > held[0]:
                    heapq.heapreplace(held, entry)
        return [(c, -at) for c, at in sorted(held, reverse=True)]

    def vote(self, near: list[tuple[float, int]],
             less: tuple[int, int, float] | None = None) -> float | None:
        """Toxic share of the neighbours' weight, nearer ones counting more.

        ``less`` takes one row's own weight out of its vector's votes.
        """
        toxic = total = 0.0
        for cosine, at in near:
            clean_rows, toxic_rows = self.votes[at]
            if less and less[0] == at:
                clean_rows -= less[2] * (less[1] == 0)
                toxic_rows -= less[2] * (less[1] == 1)
            nearness = 1.0 / (1.05 - min(cosine, 1.0))
            total += nearness * (clean_rows + toxic_rows)
            toxic += nearness * toxic_rows
        return toxic / total if total > 1e-9 else None


class Model:
    """Terms, index and the probabilities that votes stand for."""

    def __init__(self, terms: list[str], index: Index, rises: list[float],
                 no_vote: float):
        self.terms, self.index = terms, index
        self.rises, self.no_vote = rises, no_vote
        self.key = xxhash.xxh64_hexdigest(repr((
            terms, index.idf.tolist(), index.votes.tolist(), index.owners,
            list(index.place), rises, no_vote)))

    def probability(self, vote: float | None) -> float:
        """Straight lines between the steps; no neighbour has its own value."""
        if vote is None:
            return self.no_vote
        return float(np.interp(
            vote, np.linspace(0, 1, len(self.rises)), self.rises))

    def score(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple]]]:
        """Score and evidence of each text."""
        counter = term_counter(self.terms, self.key)
        for counts in counter.count(texts):
            bag = tuple(sorted(counts.items()))
            if bag not in counter.scored:
                if len(counter.scored) > KNOWN_BAGS:
                    counter.scored.clear()
                near = self.index.nearest(bag)
                counter.scored[bag] = (self.probability(self.index.vote(near)), [
                    (self.index.owners[at], int(self.index.votes[at][1]
                                                >= self.index.votes[at][0]), cosine)
                    for cosine, at in near])
            yield counter.scored[bag]


def choose_terms(used: DataFrame, rows: dict[int, int]) -> list[str]:
    """Words whose share of documents differs between the labels.

    ``used`` has ``word, clean, toxic``: in how many ways the documents of each
    label first use the word. A term is used by at least ``MIN_ROWS``, differs beyond chance and by
    a factor of ``MIN_LIFT``; at most ``MAX_TERMS``, the clearest first.
    """
    n0, n1 = max(rows.get(0, 0), 1), max(rows.get(1, 0), 1)
    a, b = F.col("toxic"), F.col("clean")
    c, d = n1 - a, n0 - b
    n = float(n0 + n1)
    chi2 = n * (a * d - b * c) ** 2 / F.greatest(
        (a + b) * (c + d).cast("double") * n0 * n1, F.lit(1.0))
    share1, share0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    lift = F.greatest(share1 / share0, share0 / share1)
    top = used.where((a + b >= MIN_ROWS) & (lift >= MIN_LIFT)).withColumn(
        "chi2", F.round(chi2, 6)).where(F.col("chi2") >= MIN_CHI2).orderBy(
        F.desc("chi2"), "word").limit(MAX_TERMS)
    return [r.word for r in top.select("word").collect()]


def _first_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each document, with the words about its first use."""
    for batch in batches:
        kinds = batch.column("toxic").to_pylist()
        row = 0
        for block in text_blocks(batch.column("text"), BLOCK_CHARS):
            words, about, toxic = [], [], []
            for text in block.to_pylist():
                run = ["", *_WORDS(text.lower()), ""]
                first: dict[str, int] = {}
                for i in range(1, len(run) - 1):
                    first.setdefault(run[i], i)
                words += first
                about += [f"{run[i - 1]} {run[i + 1]}" for i in first.values()]
                toxic += [kinds[row]] * len(first)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(about, pa.string()),
                 pa.array(toxic, pa.int32())], names=["word", "about", "toxic"])


def _document_use(terms: Broadcast):
    """Per task: how many documents there are (-1) and how many use each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found = term_counter(terms.value), Counter()
        for batch in batches:
            for block in text_blocks(batch.column("text"), BLOCK_CHARS):
                for counts in counter.count(block):
                    found[-1] += 1
                    found.update(counts.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
            names=["term", "n"])
    return count


def _bags(terms: Broadcast):
    def count(texts: pa.Array) -> pa.Array:
        counter = term_counter(terms.value)
        return pa.array(
            [sorted(counts.items()) for block in text_blocks(texts, BLOCK_CHARS)
             for counts in counter.count(block)],
            pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())])))
    return F.arrow_udf(count, "array<struct<term:int,n:int>>")


def rising(steps: list[list[float]], prior: float) -> list[float]:
    """Toxic share per step of the vote, made non-decreasing by pooling.

    ``steps``: clean and toxic weight. An empty step takes the line between its
    neighbours' values, or the vote itself if there is no neighbour.
    """
    pools = []
    for i, (clean, toxic) in enumerate(steps):
        if clean + toxic <= 0:
            continue
        # one row's worth of the overall share steadies small steps
        pools.append([toxic + prior, clean + toxic + 1.0, [i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    if not pools:
        return np.linspace(0, 1, len(steps)).tolist()
    at = [i for p in pools for i in p[2]]
    value = [p[0] / p[1] for p in pools for _ in p[2]]
    return np.interp(range(len(steps)), at, value).tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = CLASS_ROWS) -> Broadcast:
    """Learn terms, index and calibration; sent to the executors.

    The size is bounded by ``2 x rows`` examples over ``MAX_TERMS`` terms. With
    no labelled rows nothing is learned and every score is zero; with one label
    only, every score is that label.
    """
    spark = docs.sparkSession
    chosen = F.broadcast(labelled(labels, rows))  # at most 2 x rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(
        ["doc_id"]).persist()
    try:
        learning = texts.where("not judge")
        kinds = {r.toxic: r.n for r in learning.groupBy("toxic").agg(
            F.count("*").alias("n")).collect()}
        # copies of a document use its words in the same places: counted once
        words = learning.select("toxic", "text").mapInArrow(
            _first_uses, "word string, about string, toxic int").distinct().groupBy(
            "word").agg(F.sum(1 - F.col("toxic")).alias("clean"),
                        F.sum("toxic").cast("long").alias("toxic"))
        terms = choose_terms(words, kinds)
        shared = spark.sparkContext.broadcast(terms)
        bagged = texts.select(
            "doc_id", "toxic", "weight", "judge",
            _bags(shared)(F.col("text")).alias("bag")).collect()
    finally:
        texts.unpersist()
    use = {r.term: r.n for r in docs.select("text").mapInArrow(
        _document_use(shared), "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()}
    idf = np.array([math.log((1 + use.get(-1, 0)) / (1 + use.get(i, 0))) + 0.01
                    for i in range(len(terms))])
    return spark.sparkContext.broadcast(learn(terms, idf, [
        (r.doc_id, r.toxic, r.weight, r.judge, tuple((t.term, t.n) for t in r.bag))
        for r in bagged]))


def learn(terms: list[str], idf: np.ndarray, bagged: list[tuple]) -> Model:
    """Index the distinct bags, and calibrate on the rows kept for judging."""
    groups: dict[tuple, list] = {}
    for doc_id, toxic, weight, _, bag in sorted(bagged, key=lambda r: r[:2]):
        if bag:
            own = groups.setdefault(bag, [0.0, 0.0, doc_id])
            own[toxic] += weight
    bags = list(groups)
    votes = np.array([g[:2] for g in groups.values()]).reshape(-1, 2)
    index = Index(idf, bags, votes, [g[2] for g in groups.values()])
    overall = [sum(r[2] for r in bagged if r[1] == kind) for kind in (0, 1)]
    prior = overall[1] / sum(overall) if bagged else 0.0
    steps = [[0.0, 0.0] for _ in range(SCORE_STEPS + 1)]
    none = [0.0, 0.0]
    near_of: dict[tuple, list] = {}
    for _, toxic, weight, judge, bag in bagged:
        if not judge:
            continue
        if bag and bag not in near_of:
            near_of[bag] = index.nearest(bag)
        vote = index.vote(near_of[bag], (index.place[bag], toxic, weight)) if bag else None
        if vote is None:
            none[toxic] += weight
        else:
            steps[round(vote * SCORE_STEPS)][toxic] += weight
    no_vote = (none[1] + prior) / (sum(none) + 1.0)
    return Model(terms, index, rising(steps, prior), no_vote)


def score_column(model: Broadcast, text: Column) -> Column:
    """``score`` and the ``neighbours`` it rests on, best first.

    A neighbour is named by the smallest doc_id with that vector. Null and empty
    texts, and texts without a term, get the share of toxic rows among labelled
    rows without one.
    """

    def score(texts: pa.Array) -> pa.Array:
        rows = [row for block in text_blocks(texts, BLOCK_CHARS)
                for row in model.value.score(block)]
        near = pa.list_(pa.struct([
            ("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.float64()),
             pa.array([[dict(zip(("doc_id", "toxic", "cosine"), n)) for n in r[1]]
                       for r in rows], near)], names=["score", "neighbours"])

    return F.arrow_udf(score, RESULT_TYPE)(text)


def probability_column(model: Broadcast, text: Column) -> Column:
    """The score alone, where the evidence is not asked for."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(
            [row[0] for block in text_blocks(texts, BLOCK_CHARS)
             for row in model.value.score(block)], pa.float64())

    return F.arrow_udf(score, "double")(text)


def keep_clean(docs: DataFrame, model: Broadcast) -> DataFrame:
    """Drop the documents predicted to be toxic."""
    return docs.where(probability_column(model, F.col("text")) < THRESHOLD)
