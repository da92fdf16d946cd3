"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a node, good or bad. Its features are shares of kinds of characters and words in it, how often it or its
words repeat, and the same of the lines before and after. The chain learns from labelled documents,
whose label all their lines take. Forward-backward gives each line's probability of being good; their mean,
weighted by the lines' lengths, is the document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import bounded_sample, slices
from velomart.llm.quality import STOP_WORDS
from velomart.llm.words import RunHasher, by_size, mixed, of_worker

#: Labelled documents that the chain learns from at most, and lines of each.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 200
#: Score of a document without lines.
NO_LINES = 0.5

KINDS = ("lower", "upper", "digit", "stop", "comma", "loud", "symbol", "bar", "other", "high")
FEATURES = (*KINDS, "words", "word_length", "stop_words", "upper_words", "same_as_before", "repeated_words", "repeated_line", "ends", "short", "long")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class LineFeatures:
    """Features of all lines of a row of texts, worked out on their bytes."""

    def __init__(self):
        kind = np.full(256, KINDS.index("other"), np.uint8)
        for name, chars in (
            ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"),
            ("stop", b"."), ("comma", b",;:"), ("loud", b"!?"), ("symbol", b"#*$%&<>@^~_=+\\{}[]"), ("bar", b"|"), ("high", bytes(range(128, 256))),
        ):
            kind[list(chars)] = KINDS.index(name)
        kind[list(b" \t\n\x0b\x0c\r")] = len(KINDS)
        self.kind = kind
        self.words, self.lines = RunHasher(), RunHasher(b"\n")
        stops = sorted({w for words in STOP_WORDS.values() for w in words})
        self.stops = np.sort(self.words.runs([w.encode() for w in stops]).hashes)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, lengths in bytes without white space, lines of each text); lines without a word are left out."""
        raw = [(t or "").encode() for t in texts]
        words, lines = self.words.runs(raw), self.lines.runs(raw)
        data = np.frombuffer(lines.data, np.uint8)
        text_of_line = np.repeat(np.arange(len(raw)), lines.sizes)
        line_of_word = np.searchsorted(lines.starts, words.starts, "right") - 1
        n = len(lines.starts)
        count = np.bincount(line_of_word, minlength=n)
        kept = np.flatnonzero(count)
        if not len(kept):
            return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), np.zeros(len(raw), np.int64)
        at = np.searchsorted(lines.starts, np.arange(len(data)), "right") - 1 if len(data) < 1 << 16 else np.repeat(
            np.arange(-1, n), np.diff(np.concatenate([[0], lines.starts, [len(data)]]))
        )
        kinds = np.bincount(np.maximum(at, 0) * (len(KINDS) + 1) + self.kind[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)[:, :-1]
        chars = np.maximum(1, kinds.sum(axis=1))
        per_word = lambda flags: np.bincount(line_of_word, flags, minlength=n) / np.maximum(1, count)
        text_of_word = text_of_line[line_of_word]
        first = np.concatenate([[True], text_of_word[1:] != text_of_word[:-1]])
        again = np.concatenate([[False], words.hashes[1:] == words.hashes[:-1]]) & ~first
        place = np.minimum(np.searchsorted(self.stops, words.hashes), len(self.stops) - 1)
        # A word is repeated if its pair with the word before occurs elsewhere in the text.
        pair = mixed(np.concatenate([words.hashes[:1], words.hashes[:-1]]) ^ mixed(words.hashes) ^ mixed(text_of_word.astype(np.uint64) + np.uint64(1)))
        whole = mixed(lines.hashes ^ mixed(text_of_line.astype(np.uint64) + np.uint64(7)))
        last = data[np.maximum(words.ends[np.cumsum(count)[kept] - 1] - 1, 0)]
        upper = (data[words.starts] >= 65) & (data[words.starts] <= 90) & (data[words.ends - 1] != data[words.starts]) & (words.ends - words.starts > 1) & (data[np.minimum(words.starts + 1, len(data) - 1)] < 97)
        rows = np.concatenate(
            [
                kinds / chars[:, None],
                np.stack(
                    [
                        np.log1p(count), chars / np.maximum(1, count) / 5, per_word(self.stops[place] == words.hashes), per_word(upper),
                        per_word(again), per_word(_twice(pair)), _twice(whole).astype(float), np.zeros(n), count < 4, count > 60,
                    ],
                    axis=1,
                ),
            ],
            axis=1,
        )[kept].astype(np.float32)
        rows[:, FEATURES.index("ends")] = np.isin(last, list(b".!?\"'"))
        return rows, chars[kept].astype(np.float64), np.bincount(text_of_line[kept], minlength=len(raw))


def _twice(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    same = np.concatenate([[False], values[order][1:] == values[order][:-1]]) if len(values) else np.zeros(0, bool)
    out = np.zeros(len(values), bool)
    out[order] = same | np.concatenate([same[1:], [False]]) if len(values) else same
    return out


def with_neighbours(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after in its text, zeros at the ends."""
    n = len(rows)
    text = np.repeat(np.arange(len(sizes)), sizes)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    if n > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = rows[:-1] * same, rows[1:] * same
    return np.concatenate([rows, before, after, np.ones((n, 1), np.float32)], axis=1)


@dataclass
class Chain:
    """Scores of state 1 (good) per line are ``x @ weights``, of state 0 zero; ``steps[i, j]``: from state i to j."""

    weights: np.ndarray
    steps: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return with_neighbours((rows - self.mean) / self.scale, sizes)

    def marginals(self, scores: np.ndarray, sizes: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Each line's probability of being good, by forward-backward over texts of like length together.

        ``pairs``, if given, is added the expected number of each step.
        """
        out = np.zeros(len(scores))
        first = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            group = order[at : at + 512]
            group = group[sizes[group] <= max(8, 2 * sizes[group[0]])]
            at += len(group)
            steps = int(sizes[group].max())
            live = np.arange(steps)[:, None] < sizes[group][None, :]
            index = np.where(live, first[group][None, :] + np.arange(steps)[:, None], 0)
            good = np.where(live, scores[index], 0.0)
            forward = np.zeros((steps, len(group), 2))
            backward = np.zeros_like(forward)
            forward[0, :, 1] = good[0]
            for t in range(1, steps):
                before = forward[t - 1]
                new = np.stack([np.logaddexp(before[:, 0] + self.steps[0, j], before[:, 1] + self.steps[1, j]) for j in (0, 1)], axis=1)
                new[:, 1] += good[t]
                forward[t] = np.where(live[t][:, None], new, before)
            for t in range(steps - 2, -1, -1):
                after = backward[t + 1].copy()
                after[:, 1] += good[t + 1]
                new = np.stack([np.logaddexp(self.steps[j, 0] + after[:, 0], self.steps[j, 1] + after[:, 1]) for j in (0, 1)], axis=1)
                backward[t] = np.where(live[t + 1][:, None], new, 0.0)
            both = forward + backward
            out[index[live]] = (1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500))))[live]
            if pairs is not None and steps > 1:
                total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
                for i in (0, 1):
                    for j in (0, 1):
                        joint = forward[:-1, :, i] + self.steps[i, j] + backward[1:, :, j] + (good[1:] if j else 0.0) - total
                        pairs[i, j] += np.exp(joint[live[1:]]).sum()
        return out

    @classmethod
    def fit(cls, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.15) -> Chain:
        """Adam on the log likelihood of all lines taking their text's label (0 or 1 per text)."""
        mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        chain = cls(np.zeros(3 * rows.shape[1] + 1), np.zeros((2, 2)), mean, scale)
        x = chain.inputs(rows, sizes).astype(np.float64)
        y = np.repeat(labels, sizes).astype(np.float64)
        kept = np.maximum(0, sizes - 1)
        observed = np.array([[(kept * (labels == 0)).sum(), 0.0], [0.0, (kept * (labels == 1)).sum()]])
        texts = max(1, len(sizes))
        moments = [np.zeros_like(v) for v in (chain.weights, chain.weights, chain.steps, chain.steps)]
        for k in range(1, rounds + 1):
            expected = np.zeros((2, 2))
            p = chain.marginals(x @ chain.weights, sizes, expected)
            grads = [x.T @ (y - p) / texts - 0.01 * chain.weights, (observed - expected) / texts - 0.01 * chain.steps]
            for m, (g, value) in enumerate(zip(grads, (chain.weights, chain.steps), strict=True)):
                moments[2 * m] += 0.1 * (g - moments[2 * m])
                moments[2 * m + 1] += 0.01 * (g * g - moments[2 * m + 1])
                value += rate * (moments[2 * m] / (1 - 0.9**k)) / (np.sqrt(moments[2 * m + 1] / (1 - 0.99**k)) + 1e-8)
        return chain

    def scores(self, rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text the mean of its lines' probabilities, weighted by length."""
        out = np.full(len(sizes), NO_LINES)
        if len(rows):
            p = self.marginals(self.inputs(rows, sizes) @ self.weights, sizes)
            text = np.repeat(np.arange(len(sizes)), sizes)
            weight = np.bincount(text, lengths, minlength=len(sizes))
            full = weight > 0
            out[full] = np.bincount(text, lengths * p, minlength=len(sizes))[full] / weight[full]
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Learn from a bounded sample of about ``SAMPLE_DOCS`` labelled documents, chosen by a hash of doc_id.

    Only rows that are not held out are read; of a document of more than ``SAMPLE_LINES`` lines a stretch of
    so many at a hashed place is learnt, of rows that share a doc_id the smallest text. Without labelled documents of both kinds the chain is
    indifferent. Of a document with several labels the smallest counts.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
    )
    sample = bounded_sample(known, "doc_id", SAMPLE_DOCS)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, quality in zip(batch.column("text").to_pylist(), batch.column("_quality").to_pylist(), strict=True):
                rows, _, _ = of_worker("lines", LineFeatures).of([text])
                start = zlib.crc32(rows.tobytes()) % max(1, len(rows) - SAMPLE_LINES + 1)
                rows = rows[start : start + SAMPLE_LINES]
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([quality], pa.int32())], ["rows", "quality"])

    # One text for each sampled label, so that what is collected is bounded whatever repeats.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_quality").cast("int").alias("_quality"))
    found = chosen.mapInArrow(lines, "rows binary, quality int").collect()
    found = sorted(((bytes(r["rows"]), r["quality"]) for r in found if r["rows"]))
    if len({q for _, q in found}) < 2:
        n = len(FEATURES)
        return Chain(np.zeros(3 * n + 1), np.zeros((2, 2)), np.zeros(n, np.float32), np.ones(n, np.float32))
    rows = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)) for b, _ in found]
    return Chain.fit(np.concatenate(rows), np.array([len(r) for r in rows]), np.array([q for _, q in found]))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds ``score`` and ``predicted`` to every row and column of ``docs``; null and empty texts score ``NO_LINES``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((chain.weights, chain.steps, chain.mean, chain.scale))
    if taken := {"score", "predicted"} & {c.lower() for c in docs.columns}:
        docs = docs.drop(*taken)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            parts = [np.zeros(0)]
            for part in by_size(texts, 1_000_000):
                parts.append(model.scores(*of_worker("lines", LineFeatures).of(texts[part])))
            score = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(rows, schema + "score double, predicted int")
