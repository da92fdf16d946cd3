"""Language-model scoring with a log-frequency Bloom filter.

The filter holds the counts of words and word pairs of the training texts, quantised: an n-gram of level q (a
count of q binary digits) is put in q times, once per level, and once more for each 1 among the digits after the
first, of which words keep seven and pairs five. Workers probe level after level until one is missing, then
the digits, so a count is never lost and at times overstated, at the filter's error rate.
Pairs are smoothed towards words: p(w|v) = (c(vw) + M p(w)) / (c(v) + M), p(w) = (c(w) + 1) / (N + V + 1). A pair found
once may be an error, and over all words the errors would add up; it counts t / (t + e), where e is the error rate and
t = S c(v) c(w) / N how often such a pair is met once (S: the share of pairs met once). So the probabilities of all
words after a word come to about 1 whatever the size of the vocabulary.

The n-grams are gathered in segments by hash; each segment becomes a stretch of the filter, as long
as its own n-grams ask for: 13 bits for a first entry and 10 for each further one at every size, error rates of 0.2 and
0.8 %. A filter of up to
``MAX_FILTER_BYTES`` is broadcast. A larger one stays in its segments: stretches of the texts send their distinct
n-grams to the segments and get the codes back, so no task holds more than a segment or a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import slices, stage
from velomart.llm.words import GOLDEN, HashIndex, RunHasher, Runs, by_size, mixed, of_worker

#: Probes for the first entry of an n-gram and for each further one; about half of the bits are set.
FIRST_PROBES, PROBES = 9, 7
BITS_PER_PROBE = 1 / math.log(2)
#: The largest filter that is broadcast whole.
MAX_FILTER_BYTES = 1 << 27
#: Binary digits after the first that are kept of the count of a word, and of a pair.
DIGITS, PAIR_DIGITS = 7, 5
#: Characters of training text for each segment, about.
SEGMENT_CHARS = 3_000_000
#: N-grams that a task gathers before it hands them on.
GATHERED = 2_000_000
#: Bytes of text, about, that are scored together when the filter is too large to broadcast.
SCORED_BYTES = 4_000_000
#: Words whose exact counts are broadcast; the rest are joined.
FREQUENT_WORDS = 1_000_000
SMOOTHING = 300.0
#: The hash that stands for the end of a text.
END = np.uint64(0xE703)


def _nth(at: int) -> np.uint64:
    return np.uint64(at * int(GOLDEN) % (1 << 64))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def closed(found: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of the words of each text and its end."""
    return np.insert(found.hashes, np.cumsum(found.sizes), END), found.sizes + 1


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hash of each token of ``closed`` texts with the one before it; before a text's first token stands an end."""
    return mixed(np.concatenate([hashes[-1:], hashes[:-1]]) * GOLDEN + mixed(hashes + GOLDEN))


def quantised(counts: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Counts as codes: their binary digits, then the first ``digits`` ones after the leading 1, in DIGITS places; 0 for 0."""
    counts = counts.astype(np.int64)
    level = np.frexp(counts.astype(np.float64))[1].astype(np.int64)
    places = np.maximum(level - 1, 0)
    rest = counts - np.where(level > 0, np.int64(1) << places, 0)
    rest = np.where(places > DIGITS, rest >> np.maximum(places - DIGITS, 0), rest << np.maximum(DIGITS - places, 0))
    cut = DIGITS - digits
    return (level << DIGITS) + (rest >> cut << cut)


def typical(codes: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """The middle of the counts of a code."""
    level, rest = codes >> DIGITS, codes & ((1 << DIGITS) - 1)
    low = np.exp2(level - 1.0)
    return np.where(level > 0, low * (1 + rest / (1 << DIGITS)) + (np.maximum(low / (1 << digits), 1) - 1) / 2, 0.0)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Filter:
    """Segments of bits one after another; an n-gram belongs to segment hash mod their number.

    Entries of an n-gram: 1 to its level, and 64 + k for a 1 as digit k after the first.
    """

    bits: np.ndarray  # bytes of all segments
    sizes: np.ndarray  # bits of each segment
    starts: np.ndarray  # first bit of each segment
    tops: np.ndarray  # highest level of each segment

    @staticmethod
    def _probed(hashes: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
        """(first probe, step to the next) of an entry of n-grams."""
        a = mixed(hashes + _nth(entry))
        return a, mixed(a ^ GOLDEN) | np.uint64(1)

    @classmethod
    def segment(cls, hashes: np.ndarray, codes: np.ndarray, most_bits: int | None = None) -> bytes:
        """The bits of one segment."""
        levels = codes >> DIGITS
        entries = [(at, levels >= at) for at in range(1, int(levels.max(initial=0)) + 1)]
        entries += [(64 + k, (codes >> (DIGITS - 1 - k)) & 1 > 0) for k in range(DIGITS)]
        size = math.ceil(BITS_PER_PROBE * sum((FIRST_PROBES if at == 1 else PROBES) * int(own.sum()) for at, own in entries))
        size = max(64, size if most_bits is None else min(size, most_bits)) // 8 * 8
        on = np.zeros(size, bool)
        for at, own in entries:
            a, step = cls._probed(hashes[own], at)
            for _ in range(FIRST_PROBES if at == 1 else PROBES):
                on[a % np.uint64(size)] = True
                a = a + step
        return np.packbits(on, bitorder="little").tobytes()

    @classmethod
    def of_segments(cls, bits: np.ndarray, sizes: np.ndarray, tops: np.ndarray | None = None) -> Filter:
        """From the bytes of all segments in a row, the bits of each and its highest level, 63 where not known."""
        return cls(bits, sizes, np.cumsum(sizes) - sizes, np.full(len(sizes), 63) if tops is None else tops)

    def _holds(self, hashes: np.ndarray, own: np.ndarray, left: np.ndarray, entry: int) -> np.ndarray:
        """Those of the n-grams ``left`` whose entry is there."""
        size, start = self.sizes[own[left]], self.starts[own[left]]
        a, step = self._probed(hashes[left], entry)
        for _ in range(FIRST_PROBES if entry == 1 else PROBES):
            bit = start + a % size
            keep = ((self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            left, a, step, size, start = left[keep], a[keep] + step[keep], step[keep], size[keep], start[keep]
        return left

    def codes(self, hashes: np.ndarray, digits: int = DIGITS) -> np.ndarray:
        """The code of each n-gram: levels probed upwards until one is missing, or to the highest of its segment, then the digits."""
        out = np.zeros(len(hashes), np.int32)
        own = (hashes % np.uint64(len(self.sizes))).astype(np.int64)
        left, at = np.flatnonzero(self.tops[own] >= 1), 1
        while len(left):
            left = self._holds(hashes, own, left, at)
            out[left] = at << DIGITS
            at += 1
            left = left[self.tops[own[left]] >= at]
        level = out >> DIGITS
        for k in range(digits):
            out[self._holds(hashes, own, np.flatnonzero(level > k + 1), 64 + k)] |= 1 << (DIGITS - 1 - k)
        return out


@dataclass
class Answers:
    """Codes that were looked up before: those of ``hashes``, ascending."""

    hashes: np.ndarray
    found: np.ndarray

    def codes(self, hashes: np.ndarray, digits: int = DIGITS) -> np.ndarray:
        return self.found[np.searchsorted(self.hashes, hashes)].astype(np.int32) & (-1 << (DIGITS - digits))


def _gathered(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, words, word_counts, pairs, pair_counts): n-grams of stretches of the texts, summed there.

    One row for each segment that a stretch has n-grams of, so never more rows than n-grams.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            found = []
            for parts in zip(*held, strict=True):
                hashes = np.concatenate(parts)
                keys, counts = _summed(hashes, np.ones(len(hashes), np.int64))
                own = (keys % np.uint64(segments)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                found.append((own[order], keys[order], counts[order].astype(np.uint32)))
            met = np.unique(np.concatenate([own for own, _, _ in found]))
            split = [np.split(x, np.searchsorted(own, met[1:])) for own, *both in found for x in both]
            columns = [pa.array([x.tobytes() for x in column], pa.binary()) for column in split]
            return pa.RecordBatch.from_arrays([pa.array(met), *columns], ["segment", "words", "word_counts", "pairs", "pair_counts"])

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for part in by_size(texts):
                hashes, _ = closed(of_worker("words", RunHasher).words(texts[part]))
                held.append((hashes, pairs(hashes)))
                size += len(hashes)
                if size >= GATHERED:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return docs.select("text").mapInArrow(
        rows, "segment long, words binary, word_counts binary, pairs binary, pair_counts binary"
    )


@dataclass
class Model:
    filter: Filter | None  # None if it is larger than ``MAX_FILTER_BYTES``
    segments: DataFrame  # (segment, bits, top, ...): its segments, those without n-grams left out
    of: int  # how many segments there are
    counts: DataFrame  # (word, count): exact, of every training word's hash
    tokens: int
    words: int
    frequent: tuple[np.ndarray, np.ndarray]  # hashes, ascending, and exact counts of the words counted most
    least: int  # the count from which a word is among them
    error: float  # how likely an n-gram that was never met seems to be there
    once: float  # the share of pairs, each occurrence counted, that were met once


def train(docs: DataFrame) -> Model:
    """Count words and pairs of all (text) rows, each text closed by an end token; null text: that alone."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    segments = max(1, math.ceil(chars / SEGMENT_CHARS))

    def made(group: pa.Table) -> pa.Table:
        def total(kind: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [(np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)) for k, c in zip(group[f"{kind}s"], group[f"{kind}_counts"], strict=True)]
            return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))

        words, counts = total("word")
        met, often = total("pair")
        codes = np.concatenate([quantised(counts), quantised(often, PAIR_DIGITS)])
        bits = Filter.segment(np.concatenate([words, met]), codes)
        on = np.unpackbits(np.frombuffer(bits, np.uint8)).mean()
        return pa.table(
            {
                "segment": group["segment"][:1],
                "bits": pa.array([bits], pa.binary()),
                "top": pa.array([codes.max(initial=0) >> DIGITS], pa.int32()),
                "error": pa.array([on**FIRST_PROBES]),
                "once": pa.array([int((often == 1).sum())]),
                "words": pa.array([words.view(np.int64)]),
                "counts": pa.array([counts]),
            }
        )

    built = stage(
        _gathered(docs, segments).groupBy("segment").applyInArrow(made, "segment long, bits binary, top int, error double, once long, words array<long>, counts array<long>"),
        "segments",
    )
    counts = built.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        F.col("w.words").alias("word"), F.col("w.counts").alias("count")
    )
    # At most 64 rows: how many words have a count of so many binary digits.
    digits = counts.groupBy(F.length(F.bin("count")).alias("digits")).agg(F.count("*").alias("n"), F.sum("count").alias("of")).collect()
    least, room = 1 << 62, FREQUENT_WORDS
    for row in sorted(digits, key=lambda r: -r["digits"]):
        room -= row["n"]
        if room < 0:
            break
        least = 1 << (row["digits"] - 1)
    else:
        least = 1
    often = counts.where(F.col("count") >= least).toArrow()
    hashes = often["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    tokens, words = sum(r["of"] for r in digits), sum(r["n"] for r in digits)
    met = built.agg(F.sum("error").alias("error"), F.sum("once").alias("once")).first()
    frequent = hashes[order], often["count"].to_numpy()[order]
    return Model(_collected(built, segments), built, segments, counts, tokens, words, frequent, least, (met.error or 0.0) / segments, (met.once or 0) / max(1, tokens))


def _collected(built: DataFrame, segments: int) -> Filter | None:
    """The filter in the driver's memory once, if it may be broadcast: a file of segments at a time is copied to its place."""
    if 8 * segments + (built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > MAX_FILTER_BYTES:
        return None
    sizes, tops = np.full(segments, 64, np.uint64), np.zeros(segments, np.int64)
    for row in built.select("segment", F.octet_length("bits").alias("n"), "top").collect():
        sizes[row["segment"]], tops[row["segment"]] = 8 * row["n"], row["top"]
    ends = np.cumsum(sizes // np.uint64(8)).astype(np.int64)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for row in built.select("segment", "bits").toLocalIterator():
        end = int(ends[row["segment"]])
        bits[end - len(row["bits"]) : end] = np.frombuffer(row["bits"], np.uint8)
    return Filter.of_segments(bits, sizes, tops)


class Scorer:
    """Scores of texts by a filter, or answers of one; what depends on a single word is worked out once for each word met.

    Without an ``error``, a pair found once counts as met once.
    """

    def __init__(self, bits: Filter | Answers, frequent: tuple[np.ndarray, np.ndarray], tokens: int, words: int, error: float = 0.0, once: float = 1.0):
        self.filter, self.frequent, self.tokens, self.words, self.error, self.once = bits, frequent, tokens, words, error, once
        self._forget()

    def _forget(self) -> None:
        self.index, self.exact, self.count = HashIndex(), np.zeros(0, np.int64), np.zeros(0)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        if self.index.full:
            self._forget()
        numbers = self.index.find(hashes)
        missing = numbers < 0
        if missing.any():
            fresh = np.unique(hashes[missing])
            self.index.reserve(len(fresh))
            self.index.add(fresh)
            keys, counts = self.frequent
            at = np.minimum(np.searchsorted(keys, fresh), max(0, len(keys) - 1))
            exact = np.where(keys[at] == fresh, counts[at], -1) if len(keys) else np.full(len(fresh), -1)
            self.exact = np.concatenate([self.exact, exact])
            self.count = np.concatenate([self.count, typical(self.filter.codes(fresh))])
            numbers[missing] = self.index.find(hashes[missing])
        return numbers

    def probabilities(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability after the token before it, exact count or -1) of each token of ``closed`` texts."""
        numbers = self._numbers(hashes)
        alone = self.count[numbers]
        before = np.concatenate([alone[-1:], alone[:-1]])
        # A pair cannot be more frequent than either of its words; this also bounds what an error can add.
        met, at = np.unique(pairs(hashes), return_inverse=True)
        pair = np.minimum(typical(self.filter.codes(met, PAIR_DIGITS), PAIR_DIGITS)[at], np.minimum(before, alone))
        likely = self.once * before * alone / max(1, self.tokens)
        pair = np.where(pair == 1, likely / np.maximum(likely + self.error, 1e-300), pair)
        word = (alone + 1) / (self.tokens + self.words + 1)
        return (pair + SMOOTHING * word) / (before + SMOOTHING), self.exact[numbers]

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """Per text: tokens, log10 probability, tokens and base score of its frequent words, the others and how often."""
        hashes, sizes = closed(of_worker("words", RunHasher).words(texts))
        found, exact = self.probabilities(hashes)
        score = np.log10(found)
        base = np.where(exact >= 0, np.log10(np.maximum(exact, 0) + 1.0), 0.0) - math.log10(self.tokens + self.words + 1)
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, first).tolist() for x in (score, base, (exact >= 0).astype(np.int64))]
        rare = np.flatnonzero(exact < 0)
        ends = np.searchsorted(rare, first + sizes).tolist()
        own = hashes[rare].view(np.int64)
        out = []
        for k, (n, start, stop) in enumerate(zip(sizes.tolist(), [0, *ends[:-1]], ends, strict=True)):
            words, times = np.unique(own[start:stop], return_counts=True) if stop > start else (own[:0], own[:0])
            out.append((n, sums[0][k], sums[2][k], sums[1][k], words, times))
        return out


def _record(scorer: Scorer, row: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    found = [x for part in by_size(texts) for x in scorer.rows(texts[part])]
    tokens, value, known, base, rare, times = zip(*found, strict=True) if found else [()] * 6
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row, pa.int64()),
            batch.column("doc_id"),
            *[pa.array(x, t) for x, t in ((tokens, pa.int64()), (value, pa.float64()), (known, pa.int64()), (base, pa.float64()))],
            *[pa.array(x, pa.list_(pa.int64())) for x in (rare, times)],
        ],
        ["row", "doc_id", "n_tokens", "score", "known", "base", "rare", "times"],
    )


def _by_broadcast(docs: DataFrame, model: Model, schema: str) -> DataFrame:
    """The texts scored in one pass, by the whole filter."""
    bits = model.filter
    shared = docs.sparkSession.sparkContext.broadcast((bits.bits, bits.sizes, bits.tops, model.frequent, model.tokens, model.words, model.error, model.once))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes, tops, *rest = shared.value
        scorer, partition, n = Scorer(Filter.of_segments(bits, sizes, tops), *rest), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            yield _record(scorer, (partition << 40) + n + np.arange(batch.num_rows), batch)
            n += batch.num_rows

    return docs.mapInArrow(rows, schema)


def _by_segments(docs: DataFrame, model: Model, schema: str) -> DataFrame:
    """The texts scored in stretches, by what the segments of the filter answer for the distinct n-grams of each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    segments, shared = model.of, docs.sparkSession.sparkContext.broadcast((model.frequent, model.tokens, model.words, model.error, model.once))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in slices(batches):
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 1)
            number = [pa.array(partition + x) for x in (ends // SCORED_BYTES, n + np.arange(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*number, batch.column("doc_id"), batch.column("text")], ["stretch", "row", "doc_id", "text"])
            n, size = n + batch.num_rows, int(ends[-1])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for stretch, parts in held.items():
                hashes = np.unique(np.concatenate(parts))
                own = (hashes % np.uint64(segments)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                hashes, own = hashes[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), stretch)), pa.array(own[first]), pa.array([x.tobytes() for x in np.split(hashes, first[1:])], pa.binary())],
                    ["stretch", "segment", "hashes"],
                )
            held.clear()

        for batch in slices(batches):
            stretch, texts = batch.column("stretch").to_numpy(), batch.column("text").to_pylist()
            cuts = [0, *(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), len(texts)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if int(stretch[start]) not in held:
                    yield from flushed()
                own = texts[start:stop]
                for part in by_size(own):
                    hashes, _ = closed(of_worker("words", RunHasher).words(own[part]))
                    held.setdefault(int(stretch[start]), []).append(np.unique(np.concatenate([hashes, pairs(hashes)])))
        yield from flushed()

    def answered(asked: pa.Table, segment: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in asked["hashes"]]
        found = np.zeros(sum(map(len, parts)), np.uint16)
        if parts and segment.num_rows:
            bits = np.frombuffer(segment["bits"][0].as_py(), np.uint8)
            own = Filter.of_segments(bits, np.array([8 * len(bits)], np.uint64), segment["top"].to_numpy())
            found = own.codes(np.concatenate(parts)).astype(np.uint16)
        codes = [x.tobytes() for x in np.split(found, np.cumsum([len(x) for x in parts])[:-1])] if parts else []
        return pa.table({"stretch": asked["stretch"], "hashes": asked["hashes"], "codes": pa.array(codes, pa.binary())})

    def rows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers["hashes"]])
        codes = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in answers["codes"]])
        order = np.argsort(hashes)
        scorer = Scorer(Answers(hashes[order], codes[order]), *shared.value)
        return pa.Table.from_batches([_record(scorer, x.column("row").to_numpy(), x) for x in slices(iter(texts.to_batches()))])

    texts = stage(docs.mapInArrow(stretches, f"stretch long, row long, doc_id {kind}, text string"), "stretches")
    # A segment is asked by as many tasks as there is more to score than was learnt from.
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shares = max(1, math.ceil(size / (segments * SEGMENT_CHARS)))
    questions = texts.select("stretch", "text").mapInArrow(asked, "stretch long, segment long, hashes binary")
    questions = questions.withColumn("share", F.pmod(F.xxhash64("stretch"), F.lit(shares)))
    bits = model.segments.select("segment", "bits", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    answers = questions.groupBy("segment", "share").cogroup(bits.groupBy("segment", "share")).applyInArrow(
        answered, "stretch long, hashes binary, codes binary"
    )
    return texts.groupBy("stretch").cogroup(answers.groupBy("stretch")).applyInArrow(rows, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Null text: empty, its end token alone is scored. Words not among the frequent are joined with the exact
    counts, each document's occurrences summed before. Rows with one doc_id are scored apart; further
    columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, score double, known long, base double, rare array<long>, times array<long>"
    # Written, so that a row keeps its number in both uses below.
    scored = stage((_by_segments if model.filter is None else _by_broadcast)(docs.select("doc_id", "text"), model, schema), "scored")
    rest = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
        .join(model.counts.where(F.col("count") < model.least), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("rare_base"))
    )
    return scored.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
