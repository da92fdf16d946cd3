"""Phrases against a plain count of everything, border failures, exact arithmetic, odd texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velomart.llm import collocations, registry

ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = str.maketrans(ASCII, ASCII.lower())


def plain(rows, least, keep):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longest[lang, w[i : i + size]] = max(longest[lang, w[i : i + size]], a)
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) in longest and 100 * longest[lang, w] >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, own in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(own)[:keep], 1)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, f int, phrase string")


def some(count, seed=4):
    rng = random.Random(seed)
    stock = [" ".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(30)]
    gaps = [" ", "  ", "\t", ", ", ". ", "\n", "; ", " \t ", "\x0b", " "]
    out = []
    for k in range(count):
        text = "".join(rng.choice([*stock, rng.choice("AbcÉé"), f"w{k}"]) + rng.choice(gaps) for _ in range(rng.randint(0, 40)))
        out.append((k, text, rng.choice(["en", "en", "en", "de", None])))
    return out


ODD = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, " .,;\n", "en"), (3, "x y " * 500, "xx"), (3, "x y " * 500, "xx"), (4, "É É É é " * 40, "und")]


@pytest.mark.parametrize("least, keep", [(30, 2000), (5, 7)])
def test_all_phrases(spark, least, keep):
    rows = some(400) + ODD
    got = collocations.top_phrases(frame(spark, rows), least, keep, group_rows=20)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, keep)


def test_a_sample_that_proposes_nothing(spark, monkeypatch):
    """Then every frequent word, pair and triple is a failure, and pass after pass extends them."""
    passes = []
    count = collocations.border_pass
    monkeypatch.setattr(collocations, "border_pass", lambda *a: passes.append(1) or count(*a))
    monkeypatch.setattr(collocations, "PROPOSED", 1_000_000)
    rows = some(300, 5)
    assert sorted(map(tuple, collocations.top_phrases(frame(spark, rows)).collect())) == plain(rows, 30, 2000)
    assert len(passes) == 4


def test_many_segments_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT_TEXT", 2000)
    monkeypatch.setattr(collocations, "GATHERED", 500)
    monkeypatch.setattr(collocations, "CHARS", 3000)
    rows = some(300, 8)
    assert sorted(map(tuple, collocations.top_phrases(frame(spark, rows)).collect())) == plain(rows, 30, 2000)


def test_full_bits_count_everything_once(spark, monkeypatch):
    monkeypatch.setattr(collocations, "proposals", lambda docs, segments: collocations.Bits(np.full(collocations.SEGMENT // 8, 255, np.uint8)))
    rows = some(200, 6)
    assert sorted(map(tuple, collocations.top_phrases(frame(spark, rows)).collect())) == plain(rows, 30, 2000)


def test_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    found = spark.createDataFrame(
        [("en", "", 0, 9 * big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big), ("en", "a b a", 3, big - big // 5 - 1), ("en", "b a", 2, big - big // 5)],
        "lang string, phrase string, words int, f long",
    )
    got = {r.phrase: r for r in collocations.scored(found).collect()}
    assert set(got) == {"a b", "a b a"}  # "b a" lies in "a b a", which has over four fifths of it
    assert got["a b"].score == 2000000 * big // (2 * big + 8)
    assert got["a b a"].score == min(2000000 * (big - big // 5 - 1) // x for x in (big + 7 + big - big // 5, big + big + 7))


def test_no_rows(spark):
    assert collocations.top_phrases(frame(spark, ODD).where("false")).count() == 0


def test_bits_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", collocations.SEGMENT)
    docs = frame(spark, some(300, 7))
    assert collocations.proposals(docs).size == collocations.SEGMENT
    assert "op11_collocations" in registry.all_sql()


def proposing(rows, least, left_out):
    """Bits of every phrase of ``least`` occurrences, but for one in each three of those whose number of words is in ``left_out``."""
    stretch = collocations.Stretch.of([text for _, text, _ in rows], [lang or "und" for *_, lang in rows])
    hashes = np.concatenate([value[stretch.rest >= m] for m, value in enumerate(stretch.phrases(), 1)])
    hashes, counts = collocations.summed(hashes, np.ones(len(hashes), np.int64))
    often = hashes[counts >= least]
    keep = np.ones(len(often), bool)
    for m in left_out:
        keep[np.flatnonzero((often & np.uint64(3)) == m - 1)[::3]] = False
    packed = np.zeros(1 << 18, np.uint8)
    for k in range(collocations.PROBES):
        at = collocations.slot(often[keep], k, 8 * len(packed))
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return collocations.Bits(packed), int((~keep).sum())


@pytest.mark.parametrize("left_out", [(1,), (2,), (3,), (1, 2, 3)])
def test_few_failures_need_no_further_pass(spark, monkeypatch, left_out):
    """What extends them is counted in the last pass, whatever its length."""
    rows, passes = some(400, 9), []
    bits, missing = proposing(rows, 5, left_out)
    assert missing
    count = collocations.border_pass
    monkeypatch.setattr(collocations, "proposals", lambda docs, segments: bits)
    monkeypatch.setattr(collocations, "border_pass", lambda *a: passes.append(1) or count(*a))
    monkeypatch.setattr(collocations, "FEW", 1)
    assert sorted(map(tuple, collocations.top_phrases(frame(spark, rows), 5).collect())) == plain(rows, 5, 2000)
    assert len(passes) == 1


def test_the_last_pass_hands_on_what_it_holds(spark, monkeypatch):
    """By size, again and again; a task that goes on afterwards loses and repeats nothing."""
    monkeypatch.setattr(collocations, "CHARS", 500)
    monkeypatch.setattr(collocations, "TALLIED", 2000)
    rows = some(300, 10) + ODD
    assert sorted(map(tuple, collocations.top_phrases(frame(spark, rows).coalesce(1)).collect())) == plain(rows, 30, 2000)


def test_a_tally_keeps_a_text_for_each_phrase():
    texts, langs = ["a  b\tc. a b c", "A b \t c", "", None], ["en", "en", "en", "und"]
    tally = collocations.Tally()
    everything = collocations.Bits(np.full(collocations.SEGMENT // 8, 255, np.uint8))
    for _ in range(2):
        stretch = collocations.Stretch.of(texts, langs)
        tally.add(langs, stretch, list(collocations.extended(stretch, everything, None)))
    got = [tuple(row.values()) for batch in tally.batches() for row in batch.to_pylist()]
    assert sorted(got) == sorted(("en", p, p.count(" ") + 1, 6) for p in ("a", "b", "c", "a b", "b c", "a b c"))


def test_bits_are_collected_in_a_few_jobs(spark):
    """However many partitions the segments are dealt over."""
    hashes = spark.range(0, 5000, 1, 4).select((F.xxhash64("id")).alias("hash"))
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    sc = spark.sparkContext
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        sc.setJobGroup("bits", "bits")
        bits = collocations.set_bits(hashes, 1 << 20)
        jobs = len(sc.statusTracker().getJobIdsForGroup("bits"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    values = np.array([r.hash for r in hashes.collect()]).view(np.uint64)
    assert bits.has(values).all() and not bits.has(values + np.uint64(1)).all()
    assert jobs <= 3
