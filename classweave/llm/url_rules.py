"""Verdicts on URLs by a trie of allow and block rules.

A rule is a host and the start of a path. It fits a URL whose host is the rule's
or a subdomain of it and whose path starts with the rule's path. The rules are a
trie over the host's labels, last label first; a node that ends a host holds a
trie over the path's segments. Of the rules that fit, the one with the most host
labels wins, then the one with the longest path, so an allow entry below a block
entry is an exception to it, and the other way round. A URL that no rule fits
gets ``default``.

The trie goes to the workers as a list of at most ``BLOCK_RULES`` rules and about
``BLOCK_BYTES`` bytes, both counted first. A longer list goes out in blocks, each
one pass over the distinct URLs, and the longest fit over all blocks wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classweave.llm.ragged import held
from classweave.session import materialise

VERDICTS = ("block", "allow")
DEFAULT = "allow"
BLOCK_RULES = 200_000
BLOCK_BYTES = 32_000_000

MATCH_TYPE = "struct<labels:int,chars:int,rule:string,verdict:string>"

_URL = r"://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end.

    A-Z become lower case; a port or user stays. Null, or without ``://``: empty.
    """
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def labels_of(host: str) -> list[str]:
    """Host labels, last first; an empty host has none."""
    return host.split(".")[::-1] if host else []


class Node:
    """A place in the trie: its children, and what ends here.

    In the host's part ``ends`` is a path trie. In the path's part it maps the
    last, possibly unfinished, segment of a rule to (rule, verdict), and
    ``sizes`` are the lengths of those segments, longest first.
    """

    __slots__ = ("below", "ends", "sizes")

    def __init__(self):
        self.below: dict[str, Node] = {}
        self.ends = None
        self.sizes: list[int] = []

    def child(self, name: str) -> Node:
        found = self.below.get(name)
        if found is None:
            found = self.below[name] = Node()
        return found


class Trie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = Node()
        for host, path, verdict in rules:
            self._add(host, path, verdict)

    def _add(self, host: str, path: str, verdict: str) -> None:
        node = self.root
        for label in labels_of(host):
            node = node.child(label)
        if node.ends is None:
            node.ends = Node()
        *whole, last = path.split("/")
        node = node.ends
        for segment in whole:
            node = node.child(segment)
        if node.ends is None:
            node.ends = {}
        if len(last) not in node.sizes:
            node.sizes = sorted({*node.sizes, len(last)}, reverse=True)
        # of two verdicts on one rule, block wins
        if node.ends.get(last, (None, "allow"))[1] != "block":
            node.ends[last] = (host + path, verdict)

    def path_tries(self, host: str) -> list[tuple[int, Node]]:
        """The path tries on the way to the host, most labels first."""
        node, found = self.root, []
        if node.ends is not None:
            found.append((0, node.ends))
        for depth, label in enumerate(labels_of(host), 1):
            node = node.below.get(label)
            if node is None:
                break
            if node.ends is not None:
                found.append((depth, node.ends))
        return found[::-1]

    def match(self, tries: list[tuple[int, Node]], path: str) -> dict | None:
        """The longest rule for a path, below the tries of its host."""
        for labels, node in tries:
            best = longest(node, path)
            if best is not None:
                chars, (rule, verdict) = best
                return {"labels": labels, "chars": chars, "rule": rule, "verdict": verdict}
        return None


def longest(node: Node, path: str) -> tuple[int, tuple[str, str]] | None:
    """The length and value of the longest path in the trie that ``path`` starts with."""
    best, at = None, 0
    while True:
        stop = path.find("/", at)
        segment = path[at:] if stop < 0 else path[at:stop]
        # a rule's last segment may be any start of the path's segment
        for size in node.sizes:
            if size <= len(segment) and segment[:size] in node.ends:
                best = at + size, node.ends[segment[:size]]
                break
        if stop < 0:
            return best
        node = node.below.get(segment)
        if node is None:
            return best
        at = stop + 1


def clean_rules(rules: DataFrame) -> DataFrame:
    """``host, path, verdict``, each rule once.

    Hosts are in lower case, without dots at the ends; nulls are empty. A rule
    without a host fits every host, one without a path every path.
    """
    return rules.select(
        F.trim(lower_ascii(F.coalesce("host", F.lit(""))), F.lit(".")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()


def rule_blocks(rules: DataFrame) -> list[DataFrame]:
    """The rules in parts that are small enough to broadcast."""
    row = rules.agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes"),
        F.count_if(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).alias("bad"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rules have a verdict that is not one of {VERDICTS}")
    parts = max(-(-row["n"] // BLOCK_RULES), -(-(row["bytes"] or 0) // BLOCK_BYTES), 1)
    if parts == 1:
        return [rules]
    # twice as many as needed, so that no part outgrows the bound by chance
    number = F.pmod(F.xxhash64("host", "path"), F.lit(2 * parts))
    return [rules.where(number == i) for i in range(2 * parts)]


def share_rules(rules: DataFrame) -> Broadcast:
    """One block's rules on every worker, with a key to keep their trie by."""
    return rules.sparkSession.sparkContext.broadcast((
        f"url rules {uuid.uuid4().hex}",
        [tuple(r) for r in rules.select("host", "path", "verdict").collect()]))


def match_column(rules: Broadcast, host: Column, path: Column) -> Column:
    """The winning rule of a block as ``MATCH_TYPE``, or null."""
    def match(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        key, entries = rules.value
        trie = held(key, lambda: Trie(entries))
        coded = hosts.dictionary_encode()
        tries = [trie.path_tries(h) for h in coded.dictionary.to_pylist()]
        return pa.array(
            [trie.match(tries[i], p)
             for i, p in zip(coded.indices.to_pylist(), paths.to_pylist())],
            pa.struct([("labels", pa.int32()), ("chars", pa.int32()),
                       ("rule", pa.string()), ("verdict", pa.string())]))
    return F.arrow_udf(match, MATCH_TYPE)(host, path)


def best_match(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``url`` and its ``best`` rule over blocks of rules, a pass for each."""
    blocks = rule_blocks(rules)
    found = urls.select("url").distinct()
    parts = [materialise(found.select("url", match_column(
        share_rules(block), host_of(F.col("url")), path_of(F.col("url"))).alias("best")
    ).where("best is not null")) for block in blocks]
    return reduce(DataFrame.union, parts).groupBy("url").agg(F.max("best").alias("best"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url",
          default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``rule`` is null without a fit.

    Every row is kept, repeated ones too, and a null URL is one without host and
    path. Columns of ``pages`` with the names of results are replaced. ``rules``
    holds ``host, path, verdict``; without rows, all get ``default``.
    """
    rules = clean_rules(rules)
    blocks = rule_blocks(rules)
    results = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in results]
    best = "best"
    while best in (c.lower() for c in pages.columns):
        best += "_"
    p = pages.alias("p")
    address = F.col(f"p.`{url}`")
    host, path = host_of(address), path_of(address)
    if len(blocks) == 1:
        found = match_column(share_rules(rules), host, path)
    else:
        matched = best_match(rules, p.select(address.alias("url"))).alias("b")
        p, found = p.join(matched, address.eqNullSafe(F.col("b.url")), "left"), F.col("b.best")
    made = p.select(*(F.col(f"p.`{c}`") for c in kept), host.alias("host"),
                    path.alias("path"), found.alias(best))
    return made.select(
        *(F.col(f"`{c}`") for c in kept), "host", "path", F.col(best)["rule"].alias("rule"),
        F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
