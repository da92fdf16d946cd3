"""Contamination against a plain search of every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from velomart.llm import decontaminate as dc


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_equals_a_plain_search(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["É", "é", "Ünder", "a1", "日本", "K"]) if rng.random() < 0.1 else f"w{rng.randint(0, 300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([13, 14, 20, 45])))) for k in range(12)]
    items += [(20, "short one, of Six words"), (21, "w1"), (22, ""), (23, None), (None, "null item of just eight words right here"), (24, items[0][1]), (0, items[1][1])]
    docs = []
    for k in range(80):
        parts = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            s = rng.randint(0, 3)
            parts[rng.randint(0, len(parts)) :][:0] = w[s : s + rng.randint(5, 40)]
            at = rng.randint(0, len(parts))
            parts[at:at] = w[s : s + rng.randint(5, 40)]
        docs.append((k, rng.choice([" ", ", ", "\n--"]).join(p.upper() if rng.random() < 0.2 else p for p in parts)))
    docs += [(100, None), (101, ""), (102, "!?"), (5, docs[5][1]), (None, items[3][1]), (103, "x " * 4000 + items[2][1])]
    got = dc.contamination(
        spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n_hit int, item_id string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"),
    ).collect()
    expected = plain(docs, items)
    assert any(x[5] for x in expected) and any(x[2] and not x[5] for x in expected)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected


def test_clean_documents_stay(spark):
    item = " ".join(f"q{k}" for k in range(15))
    rows = [(1, item, "x"), (1, item, "x"), (2, "nothing of it", "y"), (None, None, None), (3, "clean " * 400 + item, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert Counter(map(tuple, dc.cleaned(docs, benchmark).collect())) == Counter(rows[2:])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(docs.where("false"), benchmark).count() == 0
    row = dc.contamination(docs, benchmark.where("false")).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    dc.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).explain()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", capsys.readouterr().out)
