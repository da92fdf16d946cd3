"""Near duplicates against all pairs of a small table, sketches against exact similarity."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from velomart.llm import near_duplicates as nd
from velomart.llm.words import LOWER, RunHasher


def shingle_set(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain(rows):
    """doc_id -> smallest doc_id of its class, by all pairs."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    names = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root(k)] = min(doc_id, names.get(root(k), doc_id))
    return [names.get(root(k)) for k in range(len(rows))]


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    texts = [None, "", "a b", "A b", "a b c d e", "one two three four five six"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 250))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(50)]
    texts += [" ".join([*passage, *[word() for _ in range(60)]]) for _ in range(15)]
    texts += ["La la la la la la la " * 20, "La la la la la la la " * 21]
    texts += texts[5:9] * 3
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("comparisons", [4096, 1])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, comparisons):
    monkeypatch.setattr(nd, "ROUND_COMPARISONS", comparisons)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, band int")
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert [got[k] for k, _ in rows] == plain(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text), (3, text), (None, text), (2, "other words here"), (2, "and more"), (None, "alone"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = nd.classes(docs).collect()
    assert Counter(r.class_id for r in found) == Counter([3, 3, 3, 2, 2, None, 8, 8])
    kept = nd.deduplicated(docs.selectExpr("*", "'x' AS text_key")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, text), (2, "other words here"), (2, "and more"), (None, "alone"), (8, "")])
    assert kept[0].text_key == "x"
    assert nd.classes(docs.where("false")).count() == 0
    assert nd.deduplicated(docs.where("false")).count() == 0


def test_one_document_of_each_class_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in nd.deduplicated(docs).collect())
    assert kept == sorted(set(plain(rows)))


def test_sketches_estimate_probability_jaccard():
    """Agreement of registers is the probability Jaccard similarity, for weights that differ as well."""
    rng = np.random.default_rng(2)
    keys = nd.mixed(np.arange(1, 301, dtype=np.uint64))
    a, b = np.zeros(300), np.zeros(300)
    a[:200], b[60:] = rng.integers(1, 6, 200), rng.integers(1, 6, 240)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero((a > 0) & (b > 0)))
    owner = np.concatenate([np.zeros((a > 0).sum()), np.ones((b > 0).sum())]).astype(np.int64)
    found = nd.sketches(owner, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, registers=20_000)
    assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.015)


def test_shingles_count_repeats_and_keep_short_texts():
    found = RunHasher().words(["a b c d e a b c d e a", "x y", "", "A B c d e"])
    owner, value, count = nd.shingles(found.hashes, found.sizes)
    assert np.bincount(owner, minlength=4).tolist() == [5, 1, 0, 1]
    assert sorted(count[owner == 0].tolist()) == [1, 1, 1, 2, 2]
    assert value[owner == 3][0] in value[owner == 0]


def test_links_whatever_the_texts_repeat(spark):
    """Sets at 0.8 and more are one class, also if one text has a passage 20 or 100 times."""
    rng, rows = random.Random(6), []
    for k in range(100):
        base = [f"w{k}x{n}" for n in range(300)]
        other = list(base)
        for at in rng.sample(range(60, 300), 5):
            other[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*other, *other[:60] * rng.choice([20, 100])]))]
    sets = [shingle_set(t) for _, t in rows]
    linked = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(linked) > 90
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(100)] == linked


def crowd(seed, size, words=150):
    """Copies of one text with so many edits that they lie on both sides of 0.8 of one another, and copies of those."""
    rng = random.Random(seed)
    base, texts = [f"b{k}" for k in range(words)], []
    while len(texts) < size:
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
        if rng.random() < 0.1:
            copy[rng.randrange(words)] = "again"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_a_crowd_about_the_threshold(spark, monkeypatch):
    """No link is lost, and few of all pairs are compared: texts that no other can be linked to meet the first and the middle one alone."""
    seen, compare = [], nd.compared
    monkeypatch.setattr(nd, "compared", lambda pairs, sets: seen.append(pairs.count()) or compare(pairs, sets))
    rows = crowd(11, 700)
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = plain(rows)
    assert [got[k] for k, _ in rows] == expected
    assert len(set(expected)) > 50 and max(Counter(expected).values()) > 250
    assert sum(seen[1:]) < 0.08 * len(rows) ** 2 / 2


def test_bound_is_never_below_what_two_texts_share(spark):
    rows = crowd(12, 60) + [(100 + k, t) for k, t in crowd(13, 30, 40)]
    docs = nd.with_key(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["text_key"])
    sets = nd.shingle_sets(docs)
    groups = docs.selectExpr("1L AS ref", "text_key")
    found = {r.text_key: r for r in nd.distances(groups, sets).collect()}
    own = {r.text_key: set(r.set) for r in sets.collect()}
    counts = Counter(x for s in own.values() for x in s)
    major = {x for x, n in counts.items() if 2 * n > len(own)}
    for a, s in own.items():
        assert found[a].apart == len(s ^ major)
        for b, t in own.items():
            if a != b:
                assert len(s ^ t) >= found[a].apart + found[b].apart - 2 * min(found[a].shared, found[b].shared)


def test_every_link_of_the_given_documents(spark):
    """Link recall by all pairs that share a shingle: 1.0 over sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets, holders = [shingle_set(t) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    both = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert len(links) > 50 and all(got[rows[a][0]] == got[rows[b][0]] for a, b in links)
