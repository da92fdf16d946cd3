"""Language-model scores: exact base counts, a filter that never loses a count, held-out gain."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from velomart.llm import lm
from velomart.llm.words import LOWER, mixed


def test_filter_never_loses_and_rarely_invents():
    rng = np.random.default_rng(3)
    keys = mixed(np.arange(1, 20_001, dtype=np.uint64))
    codes = lm.quantised(rng.geometric(0.3, len(keys)) ** 3)
    segments = [lm.Filter.segment(keys[own], codes[own], 1 << 40) for own in (keys % np.uint64(4) == np.uint64(k) for k in range(4))]
    joined = lambda parts: lm.Filter.of_segments(np.frombuffer(b"".join(parts), np.uint8), np.array([8 * len(x) for x in parts], np.uint64))
    bits = joined(segments)
    found = bits.codes(keys)
    assert (found >= codes).all()
    assert (found == codes).mean() > 0.95
    assert (bits.codes(mixed(np.arange(30_000, 130_000, dtype=np.uint64))) > 0).mean() < 0.004
    assert bits.codes(keys[:0]).tolist() == []
    tight = joined([lm.Filter.segment(keys, codes, 8 * 40_000)])
    assert len(tight.bits) <= 40_000
    assert (tight.codes(keys) >> lm.DIGITS >= codes >> lm.DIGITS).all()


@pytest.mark.parametrize("digits", [lm.DIGITS, lm.PAIR_DIGITS])
def test_quantised_counts(digits):
    counts = np.concatenate([np.arange(5000), np.array([10**6, 10**9, 10**14 + 7])])
    codes = lm.quantised(counts, digits)
    back = lm.typical(codes, digits)
    exact = counts < 2 << digits
    assert (back[exact] == counts[exact]).all()
    assert (np.abs(back - counts) <= counts / (2 << digits)).all()
    assert (np.diff(codes) >= 0).all()


def plain_model(texts, error):
    """Counts of words and pairs as the filter keeps them, and the probability of a word after another."""
    closed = [[*(t or "").encode().translate(LOWER).split(), b" "] for t in texts]
    words = Counter(w for t in closed for w in t)
    follow = Counter(p for t in closed for p in zip([b" ", *t], t, strict=False))
    kept = lambda n, digits: float(lm.typical(lm.quantised(np.array([n]), digits), digits)[0])
    words_kept = {w: kept(n, lm.DIGITS) for w, n in words.items()}
    follow_kept = {p: kept(n, lm.PAIR_DIGITS) for p, n in follow.items()}
    total, distinct = sum(words.values()), len(words)
    once = sum(n == 1 for n in follow.values()) / total

    def probability(before, word):
        alone = (words_kept.get(word, 0) + 1) / (total + distinct + 1)
        v = words_kept.get(before, 0)
        pair = min(follow_kept.get((before, word), 0), v, words_kept.get(word, 0))
        if pair == 1:
            likely = once * v * words_kept[word] / total
            pair = likely / (likely + error)
        return (pair + lm.SMOOTHING * alone) / (v + lm.SMOOTHING)

    return words, probability


@pytest.mark.parametrize("broadcast", [True, False])
def test_scores_are_those_of_a_plain_model_whose_probabilities_add_up(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lm, "SEGMENT_CHARS", 5000)
    if not broadcast:
        monkeypatch.setattr(lm, "MAX_FILTER_BYTES", 500)
        monkeypatch.setattr(lm, "SCORED_BYTES", 9000)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 150) % 400) for _ in range(400)] + ["", None]
    learnt, asked = texts[100:], [*texts[:100], "never w1 met w2", "", None]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = lm.train(frame(learnt))
    assert (model.filter is not None) == broadcast
    assert 0 < model.error < 0.004
    words, faultless = plain_model(learnt, 0)
    _, probability = plain_model(learnt, model.error)
    sums = [sum(faultless(v, w) for w in [*words, b"never"]) for v in [*words, b"never"]]
    assert max(abs(x - 1) for x in sums) < 0.01
    if broadcast:  # what the filter says of any word after any word, errors included
        scorer = lm.Scorer(model.filter, model.frequent, model.tokens, model.words, model.error, model.once)
        hashes, _ = lm.closed(lm.RunHasher().words([b" ".join(w for w in words if w != b" ").decode()]))
        sums = [scorer.probabilities(np.stack([np.full(len(hashes), v), hashes], axis=1).ravel())[0][1::2].sum() for v in hashes]
        assert abs(np.mean(sums) - 1) < 0.01
        assert np.quantile(np.abs(np.array(sums) - 1), 0.9) < 0.02
    got = {r.doc_id: r.score for r in lm.score(frame(asked), model).collect()}
    for k, text in enumerate(asked):
        tokens = [b" ", *(text or "").encode().translate(LOWER).split(), b" "]
        score = sum(math.log10(probability(v, w)) for v, w in zip(tokens, tokens[1:], strict=False))
        assert got[k] == pytest.approx(score, rel=0.01), k


def test_stretches_hand_on_segments_that_they_meet_only(spark, monkeypatch):
    monkeypatch.setattr(lm, "GATHERED", 10)
    docs = spark.createDataFrame([(f"a{k} b{k} c{k}",) for k in range(50)], "text string")
    rows = lm._gathered(docs, 5000).collect()
    assert len(rows) <= 50 * 8
    assert all(len(r["words"]) + len(r["pairs"]) > 0 for r in rows)


@pytest.mark.parametrize("frequent", [1_000_000, 8])
def test_base_is_exact(spark, monkeypatch, frequent):
    """Also when most words are joined instead of broadcast, and with several segments and flushes."""
    monkeypatch.setattr(lm, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(lm, "SEGMENT_CHARS", 1000)
    monkeypatch.setattr(lm, "GATHERED", 500)
    rng = np.random.default_rng(0)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, 60) % 500) for _ in range(60)] + [None, "", "  ", "never seen"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(1, "again", 1, "x"), (1, "again", 1, "x"), (None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, score string")
    learnt = docs.where("doc_id < 50")
    model = lm.train(learnt)
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), b" "]
    counts = Counter(w for k, t, *_ in rows if k is not None and k < 50 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (total, distinct)
    got = lm.score(docs, model).collect()
    assert len(got) == len(rows)
    expected = sorted(
        (
            -1 if k is None else k, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)),
            round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6),
        )
        for k, t, *_ in rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.train_tokens == total for r in got)


def test_repeated_phrases_score_better(spark):
    phrases = ["the quick brown fox", "jumps over lazy dogs", "colourless green ideas sleep", "furiously tonight again"]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(phrases, 30))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(docs.where("doc_id >= 150"), lm.train(docs.where("doc_id < 150"))).collect()
    assert all(r.score > r.base_score for r in got)


def test_nothing_to_learn_or_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = lm.train(none)
    row = lm.score(one, model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert lm.score(none, lm.train(one)).count() == 0


def test_a_filter_too_large_to_broadcast_scores_the_same(spark, monkeypatch):
    """As many bits for each entry at every size: beyond the broadcast, the segments are asked and nothing is overstated."""
    monkeypatch.setattr(lm, "SEGMENT_CHARS", 2000)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 900)) for k in range(120)]
    rows += [(None, None), (3, ""), (3, ""), (4, "never met before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda model: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.score(docs, model).collect())
    whole = lm.train(docs.where("doc_id < 60"))
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", 500)
    monkeypatch.setattr(lm, "SCORED_BYTES", 3000)
    large = lm.train(docs.where("doc_id < 60"))
    assert whole.filter is not None and large.filter is None
    expected = scores(whole)
    assert len(expected) == len(rows) and scores(large) == expected


def test_levels_end_at_the_highest_of_the_segment():
    """Also where every bit is set."""
    full = lm.Filter.of_segments(np.full(8, 255, np.uint8), np.array([64], np.uint64), np.array([3]))
    assert (full.codes(mixed(np.arange(1, 9, dtype=np.uint64))) >> lm.DIGITS).tolist() == [3] * 8
