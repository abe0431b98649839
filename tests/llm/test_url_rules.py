"""URL rules against a plain definition, in one block and in many."""

import random

import pytest
from pyspark.sql import functions as F

from classweave.llm import queries, url_rules
from compare import compare, connect

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), (".Example.COM", "/de/", "block"),
    ("org", "/fr/", "allow"), ("a.example.net", "", "block"), ("a.example.net", "/x", "allow"),
    ("a.example.net", "/x/y", "block"), ("a.example.net", "/x/y", "allow"), ("", "/private", "block"),
    (None, None, "allow"), ("net", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "://", "http://NET/", "http://net", "http://net?/en/",
    "https://www.example.net/en/1", "https://notexample.net/en/1", "https://x.example.com/de/",
    "https://x.example.com/de", "http://a.example.net/xylophone", "http://a.example.net/x/y/z",
    "http://b.a.example.net", "http://q.org/fr/#/en/", "http://user@net:80/", "a://b://net/",
    "http://zz/private/1", "http://org/fr/" + "long/" * 50_000, "http://" + "a." * 20_000 + "net/",
    "http://example.net//en/", "http://\n.net/x\ny",
]


def plain(url, rules, default):
    _, mark, rest = (url or "").partition("://")
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower().strip("."), p or ""
        fits = not h or host == h or host.endswith("." + h)
        if fits and path.startswith(p):
            key = (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v)
            best = max(best or key, key)
    return host, path, best and best[3], best[4] if best else default


def frame(spark, urls, rules):
    pages = spark.createDataFrame(
        [(i, u, "h", 1, "b") for i, u in enumerate(urls)],
        "page_id long, url string, host string, Verdict int, best string")
    return pages, spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("rules", [RULES, RULES[:8], []])
def test_equals_plain(spark, rules):
    pages, table = frame(spark, URLS, rules)
    found = url_rules.judge(pages, table, default="block")
    assert found.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules, "block"), r.url
    assert found.count() == len(URLS)


def test_blocks_equal_one(spark, monkeypatch):
    draw = random.Random(5)
    part = lambda: ".".join(draw.choice("abc") for _ in range(draw.randint(0, 4)))
    path = lambda: "".join(draw.choice("/ab") for _ in range(draw.randint(0, 5)))
    rules = [(part(), path(), draw.choice(url_rules.VERDICTS)) for _ in range(150)]
    urls = [f"x://{part()}/{path()}" for _ in range(400)] + [None, "x://a.b/a"] * 40
    pages, table = frame(spark, urls, rules)
    whole = sorted(url_rules.judge(pages, table).collect())
    assert [tuple(r[-4:]) for r in whole] == [plain(r.url, rules, "allow") for r in whole]
    monkeypatch.setattr(url_rules, "BLOCK_RULES", 40)
    assert len(url_rules.rule_blocks(url_rules.clean_rules(table))) > 2
    assert sorted(url_rules.judge(pages, table).collect()) == whole


def test_empty_and_bad(spark):
    pages, table = frame(spark, URLS, RULES)
    assert url_rules.judge(pages.where("page_id < 0"), table).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(pages, table.withColumn("verdict", F.lit(None).cast("string")))


def test_query_equals_sql(spark):
    for size in ("0.001", "0.01"):
        sf = f"/root/testdata/sf{size}"
        assert compare(queries.QUERIES["op13_url_filter"](spark, sf), connect(sf),
                       queries.ORACLES["op13_url_filter"]) is None
