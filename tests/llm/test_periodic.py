"""Periodic runs against a search over all stretches and periods, and the contract's digests against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from velomart.llm import periodic, registry


def plain(words):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(start, start + length - p)))
            if smallest == q and length >= max(6, 4 * q):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    texts = [[w.encode() for w in t] for t in texts]
    sizes = np.array([len(t) for t in texts])
    rows = periodic.runs(periodic.numbered(texts), sizes)
    begin = np.cumsum(sizes) - sizes
    out = [[] for _ in texts]
    for start, end, period in rows.tolist():
        k = int(np.searchsorted(begin, start, side="right")) - 1
        while not sizes[k]:
            k -= 1
        out[k].append((start - begin[k], end - start, period))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=5))
def test_runs_of_two_words(texts):
    assert found(texts) == [plain(t) for t in texts]


def test_runs_of_repeated_stretches():
    rng = random.Random(1)
    texts = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 4)):
            stretch = [rng.choice("abcdef") for _ in range(rng.randint(1, 25))]
            text += (stretch * rng.randint(1, 7))[: rng.randint(1, 200)] + [rng.choice("abx")] * rng.randint(0, 8)
        texts.append(text)
    assert found(texts) == [plain(t) for t in texts]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *rest, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)))


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "a b " * 9), (4, "a b " * 9), (5, "\n".join("uvw" * 5)), (6, "é \x0b" * 50)]
    rows += [(k, " ".join(rng.choices("abcde", k=rng.randint(0, 90)))) for k in range(100, 400)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, runs int, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.all_queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(1 for r in rows if r[0] and zlib.crc32(str(r[0]).encode()) % 10 == 0) > 10
    assert periodic.collapsed(docs.where("false")).count() == 0


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(50_000)] + ["a", "b", "c"] * 30_000 + [f"v{k % 7000}" for k in range(28_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic.collapsed(docs).first()
    assert [tuple(r) for r in row.runs] == [(50_000, 90_000, 3), (140_000, 28_000, 7000)]
    assert row.collapsed == " ".join(words[:50_003] + words[140_000:147_000])


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in registry.all_queries()["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in docs.collect() if len(r.text) < 4000]
    assert len(short) > 50
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
