"""Rules over urls against a test of every rule on every url."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from velomart.llm import registry, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def plain(rows, rules):
    table = {}
    for host, path, verdict in rules:
        at = ("".join(c.lower() if c.isascii() else c for c in host or ""), path or "")
        table[at] = max(table.get(at, ""), verdict)
    out = []
    for page_id, url in rows:
        host, path = parts(url)
        fits = [
            (len(h + p), h.count("."), h + p, v)
            for (h, p), v in table.items()
            if (host == h or (h and host.endswith("." + h))) and path.startswith(p)
        ]
        rule = max(fits, default=(0, 0, None, "allow"))
        out.append((page_id, host, path, rule[2], rule[3]))
    return Counter(out)


def judged(spark, rows, rules):
    pages = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, host string, row int")
    found = url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return Counter(map(tuple, found.collect()))


ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "https://a.example.net/en/", "https://example.net/EN/",
    "http://a.net.:80/", "http://u@b.net/a", "x://y://z.org/fr/", "http://é.ÉX.org/fr/ü?q#f", "http://a.org?x=/fr/", "http://a.org#/fr/", "http://anet/en/",
    "http://a..net/", "http://.net/", "http://org/fr/\nnext", "http://example.com/de/" + "x" * 3000, "http://" + "a." * 400 + "net/q",
]


@pytest.mark.parametrize("cell_rows", [5000, 3])
def test_every_rule_on_every_url(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(url_filter, "CELL_ROWS", cell_rows)
    rng = random.Random(3)
    hosts = ["a.b.c.net", "b.c.net", "c.net", "net", "x.c.net", "org", "b.org", "bc.net", "c.org", ""]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "", "/a/b" + "z" * 1500, "/a/b" + "z" * 1500 + "y"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40)]
    rules += [("C.NET", "/a", "block"), ("c.net", "/a", "allow"), (None, None, "block"), ("z.b.c.net", "/a", "allow")]
    rows = [(k, u) for k, u in enumerate(ODD)] + [(None, "http://c.net/a"), (7, "http://c.net/a")]
    rows += [(rng.randint(0, 50), f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'q'])}") for _ in range(400)]
    rows += [(1, "http://a.b.c.net/a/b/c")] * 300
    assert judged(spark, rows, rules) == plain(rows, rules)


def test_hot_url_is_cut(spark):
    keys = spark.range(20_000).selectExpr("'net.hot//a' AS key", "xxhash64(id) AS salt")
    at = url_filter.cuts(keys, 8)
    assert len(at) == 15 and len({k for k, _ in at}) == 1


def test_fixed_rules_no_rules_and_no_pages(spark):
    rows = list(enumerate(ODD))
    assert judged(spark, rows, url_filter.RULES) == plain(rows, url_filter.RULES)
    assert {r[3:] for r in judged(spark, rows, [])} == {(None, "allow")}
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none, url_filter.rules_table(spark)).count() == 0


def test_nested_rules_reach_every_cell(spark):
    """Deep nesting is sent to each cell once, however many rules are in all."""
    rules = [("net", "/" + "a/" * k, "block") for k in range(30)] + [(f"h{k}.org", "/", "allow") for k in range(300)]
    rows = [(k, f"http://h{k % 300}.{'net' if k % 3 else 'org'}/" + "a/" * (k % 40)) for k in range(2000)]
    assert judged(spark, rows, rules) == plain(rows, rules)


def test_registered(spark):
    assert "op12_url_filter" in registry.all_sql()
