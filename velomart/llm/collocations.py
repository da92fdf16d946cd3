"""Phrase collocation mining by Toivonen's method.

A hashed sample of the rows proposes phrases, by a lowered threshold. One full pass counts, over all
rows, the proposed phrases and their negative border: the phrases that were not proposed themselves but whose
two parts, without the last and without the first word, were. Every single word belongs to one or the other. A phrase
of the border that turns out frequent is a failure: it may have frequent extensions that nobody counted. Many failures join
the proposed and another full pass counts the border that has grown, until few fail or none. Phrases have ``MOST_WORDS`` words
at most, so the passes end.

These passes count 64-bit hashes, sent as sorted stretches of a segment of all hashes; as two phrases of one hash can only
count too much, a last pass counts by the phrases themselves those whose hash was frequent. The extensions of few failures need no
pass of their own: the last one counts all of them, of any length, whose parts are frequent or such extensions. Every frequent
phrase is thus counted by itself, as all its parts are frequent, and what is returned is exact, unless two phrases of one hash
meet in one tally.
What is proposed, or frequent, is known to the tasks as bits, of which each phrase sets three by its hash; a phrase that finds
its bits set by others is counted without need, which changes no result. Bits never are more than ``MOST_BITS``, so what is
broadcast is bounded whatever the input.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velomart.llm.common import slices, stage
from velomart.llm.words import GOLDEN, HashIndex, RunHasher, by_size, mixed, of_worker

MOST_WORDS, LEAST, KEEP = 4, 30, 2000
#: A longer phrase with so many hundredths of a phrase's count makes that phrase redundant.
CONTAINED = 80
#: One row in so many is sampled; phrases that the sample holds so often are proposed (7.5 times are expected at ``LEAST``).
SAMPLE, PROPOSED = 4, 3
#: Bits for each proposed phrase, and bits in all: 64 MB.
BITS_EACH, MOST_BITS = 32, 1 << 29
SEGMENT = 1 << 16
PROBES = 3
PIECES = b".,;:!?\n\x0b\x0c\r"
#: Characters worked on at a time, hashes that a task sums up at a time, bytes of text to a segment of the hashes.
CHARS, GATHERED, SEGMENT_TEXT = 1_000_000, 2_000_000, 4_000_000
#: Failures are few if they are one in so many of the frequent phrases found, or fewer.
FEW = 8
#: Bytes of text whose phrases a task of the last pass sums up at a time. Whole tasks would hand on fewer rows, but as
#: many as tasks times frequent phrases, which grows faster than the text while a task still meets most of them.
TALLIED = 4_000_000


@dataclass
class Bits:
    """Three bits for each phrase that was proposed; ``packed`` has eight to a byte."""

    packed: np.ndarray

    @property
    def size(self) -> int:
        return 8 * len(self.packed)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for k in range(PROBES):
            at = slot(hashes[left], k, self.size)
            left = left[(self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out


def slot(hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    """The place of each hash's bit number ``k``; ``size`` is a power of two."""
    return (mixed(hashes + np.uint64(k * int(GOLDEN) % (1 << 64))) & np.uint64(size - 1)).astype(np.int64)


def set_bits(hashes: DataFrame, size: int) -> Bits:
    """The bits of all rows of ``hashes`` (one column ``hash``), put together segment by segment in tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.unique(np.concatenate([slot(own, k, size) for k in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(own // SEGMENT), pa.array((own % SEGMENT).astype(np.int32))], ["segment", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for at in batch.column("places"):
                bits = np.zeros(SEGMENT, np.uint8)
                bits[at.values.to_numpy()] = 1
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(packed, pa.binary())], ["segment", "packed"])

    # A segment has SEGMENT places at most, so its list is bounded.
    found = hashes.mapInArrow(places, "segment long, at int").groupBy("segment").agg(F.collect_set("at").alias("places"))
    whole = np.zeros(size // 8, np.uint8)
    # In one job, not one for each partition; MOST_BITS bounds what is collected.
    for row in found.mapInArrow(pack, "segment long, packed binary").collect():
        whole[row["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(row["packed"], np.uint8)
    return Bits(whole)


@functools.cache
def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest())


@dataclass
class Stretch:
    """The words of some texts, and of every word its language and the words that its piece still has, itself included."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    rest: np.ndarray
    seeds: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], langs: list[str]) -> Stretch:
        found = of_worker("phrases", lambda: RunHasher(b" \t" + PIECES)).words(texts)
        ends_piece = np.zeros(256, np.int32)
        ends_piece[list(PIECES)] = 1
        piece = np.cumsum(ends_piece[np.frombuffer(found.data, np.uint8)])[found.starts] if len(found.starts) else found.starts
        close = np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece))
        sizes = np.diff(np.append(0, close))
        owner = np.repeat(np.arange(len(texts)), found.sizes)
        seeds = np.array([_language(x) for x in langs], np.uint64)[owner]
        return cls(found.data, found.starts, found.ends, owner, np.repeat(close, sizes) - np.arange(len(piece)), seeds, found.hashes)

    def phrases(self) -> Iterator[np.ndarray]:
        """The hash of the phrase that begins at each word, for 1, 2, … words; those beyond the piece are meaningless.

        Its two low bits say how many words it has.
        """
        value = mixed(self.hashes ^ self.seeds)
        for m in range(1, MOST_WORDS + 1):
            if m > 1:
                further = np.zeros_like(value)
                further[: max(0, len(value) - m + 1)] = self.hashes[m - 1 :]
                value = mixed(value * GOLDEN + further)
            yield (value & ~np.uint64(3)) | np.uint64(m - 1)

    def texts(self, at: np.ndarray, words: np.ndarray) -> pa.Array:
        """The phrases of so many words that begin at some words, by single spaces."""
        last = at + words - 1
        out = [self.data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[last].tolist(), strict=True)]
        ends = self.ends[:-1]
        wide = np.append(0, np.cumsum((self.starts[1:] - ends != 1) | (np.frombuffer(self.data, np.uint8)[ends] != ord(" "))))
        for k in np.flatnonzero(wide[last] > wide[at]).tolist():
            out[k] = b" ".join(out[k].split())
        return pa.array(out, pa.binary()).cast(pa.string())


def _next(flags: np.ndarray) -> np.ndarray:
    return np.append(flags[1:], False)


def walked(stretch: Stretch, bits: Bits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, border, known) for 1, 2, … words: where both parts are known, every single word included, and where the phrase is too."""
    known = np.ones(len(stretch.hashes), bool)
    for m, value in enumerate(stretch.phrases(), 1):
        border = known & _next(known) & (stretch.rest >= m) if m > 1 else known
        known = np.zeros(len(value), bool)
        at = np.flatnonzero(border)
        known[at[bits.has(value[at])]] = True
        yield value, border, known


def to_count(stretch: Stretch, now: Bits, before: Bits | None) -> Iterator[np.ndarray]:
    """Hashes of the phrases that are proposed or in the border now and were not before."""
    if before is None:
        yield from (value[border] for value, border, _ in walked(stretch, now))
    else:
        for (value, border, _), (_, earlier, _) in zip(walked(stretch, now), walked(stretch, before), strict=True):
            yield value[border & ~earlier]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Stretch]]:
    for batch in slices(batches, 2048):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for part in by_size(texts, CHARS):
            yield langs[part], Stretch.of(texts[part], langs[part])


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else order
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def often(docs: DataFrame, pick: Callable[[Stretch], Iterator[np.ndarray]], least: int, segments: int) -> DataFrame:
    """(hash): the hashes that ``pick`` takes ``least`` times or more from all texts.

    Tasks sum up what they gather and send it cut by segment, sorted; a segment, which grows with
    the distinct phrases of ``SEGMENT_TEXT`` bytes of text, is summed up by one task.
    """
    width = 64 - (segments.bit_length() - 1)

    def cut(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, counts = summed(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
        segment = (hashes >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(len(hashes), np.int64)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else segment
        edges = pa.array(np.append(first, len(hashes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (hashes.view(np.int64), counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(segment[first]), *lists], ["segment", "hashes", "counts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for _, stretch in _stretches(batches):
            found = np.concatenate(list(pick(stretch)))
            gathered.append(summed(found, np.ones(len(found), np.int64)))
            held += len(gathered[-1][0])
            if held >= GATHERED:
                yield cut(gathered)
                gathered, held = [], 0
        if held:
            yield cut(gathered)

    def whole(own: pa.Table) -> pa.Table:
        hashes = pa.chunked_array([x.flatten() for x in own.column("hashes").chunks], pa.int64()).to_numpy().view(np.uint64)
        counts = pa.chunked_array([x.flatten() for x in own.column("counts").chunks], pa.int32()).to_numpy().astype(np.int64)
        hashes, counts = summed(hashes, counts)
        return pa.table({"hash": hashes[counts >= least].view(np.int64)})

    sent = _texts(docs).mapInArrow(rows, "segment long, hashes array<long>, counts array<int>")
    return stage(sent.groupBy("segment").applyInArrow(whole, "hash long"), "often")


def bits_for(hashes: DataFrame, room: int = 1) -> Bits:
    """Bits of the hashes, with room for so many times their number."""
    size, wanted = SEGMENT, BITS_EACH * room * hashes.count()
    while size < min(MOST_BITS, wanted):
        size *= 2
    return set_bits(hashes, size)


def proposals(docs: DataFrame, segments: int = 1) -> Bits:
    """What the sample proposes: words and pairs first, longer phrases of proposed pairs then."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)

    def short(stretch: Stretch) -> Iterator[np.ndarray]:
        for m, value in enumerate(stretch.phrases(), 1):
            if m <= 2:
                yield value[stretch.rest >= m]

    known = bits_for(often(sample, short, PROPOSED, segments), room=2)
    packed = docs.sparkSession.sparkContext.broadcast(known.packed)

    def long(stretch: Stretch) -> Iterator[np.ndarray]:
        bits, pairs = Bits(packed.value), None
        for m, value in enumerate(stretch.phrases(), 1):
            if m == 2:
                pairs = (stretch.rest >= 2) & bits.has(value)
            if m > 2:
                # All pairs of the phrase, the last of which starts m - 2 words on.
                pairs_all = functools.reduce(np.logical_and, (np.append(pairs[k:], np.zeros(min(k, len(pairs)), bool)) for k in range(m - 1)))
                yield value[pairs_all]

    return Bits(known.packed | set_bits(often(sample, long, PROPOSED, segments), known.size).packed)


def failures(counts: DataFrame, now: Bits) -> DataFrame:
    """(hash): frequent phrases that can be extended and were not proposed."""
    bits = counts.sparkSession.sparkContext.broadcast(now.packed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            failed = ((hashes & np.uint64(3)) < np.uint64(MOST_WORDS - 1)) & ~Bits(bits.value).has(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[failed].view(np.int64))], ["hash"])

    return stage(counts.mapInArrow(rows, "hash long"), "failures")


def border_pass(docs: DataFrame, now: Bits, before: Bits | None, least: int, segments: int) -> DataFrame:
    """(hash): the frequent ones of what is proposed or in the border now and was not before; one pass over all rows."""
    packed = docs.sparkSession.sparkContext.broadcast((now.packed, before.packed if before else None))

    def due(stretch: Stretch) -> Iterator[np.ndarray]:
        new, old = packed.value
        return to_count(stretch, Bits(new), None if old is None else Bits(old))

    return often(docs, due, least, segments)


def extended(stretch: Stretch, frequent: Bits, failed: Bits | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) for 1, 2, … words: of the phrases whose hash was frequent, and of those that extend a failure.

    The latter have not been counted: a part of theirs was not proposed, or has not been counted itself.
    """
    known = further = None
    for m, value in enumerate(stretch.phrases(), 1):
        border = np.ones(len(value), bool) if known is None else known & _next(known) & (stretch.rest >= m)
        uncounted = np.zeros(len(value), bool) if further is None else border & (further | _next(further))
        at = np.flatnonzero(border & ~uncounted)
        at = at[frequent.has(value[at])]
        known, further = uncounted.copy(), uncounted
        known[at] = True
        if failed is not None:
            further[at[failed.has(value[at])]] = True
        yield value, np.flatnonzero(known)


class Tally:
    """How often the phrases of some stretches are there, each with its language and its text once.

    Phrases of one 64-bit hash are taken for the same within a tally.
    """

    NAMES = ("lang", "phrase", "words", "n")

    def __init__(self):
        self.index, self.counts, self.parts, self.read = HashIndex(), np.zeros(0, np.int64), [], 0

    def add(self, langs: list[str], stretch: Stretch, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        at = np.concatenate([places for _, places in found])
        hashes = np.concatenate([value[places] for value, places in found])
        numbers = self.index.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            self.index.reserve(len(fresh))
            self.index.add(fresh)
            numbers[missing] = self.index.find(hashes[missing])
            own, words = at[missing[first]], (fresh & np.uint64(3)).astype(np.int32) + np.int32(1)
            self.parts.append((pa.array(langs, pa.string()).take(pa.array(stretch.owner[own])), stretch.texts(own, words), pa.array(words)))
        self.read += len(stretch.data)
        counts = np.bincount(numbers, minlength=self.index.count)
        counts[: len(self.counts)] += self.counts
        self.counts = counts

    @property
    def full(self) -> bool:
        return self.index.full or self.read >= TALLIED

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [pa.chunked_array(x) for x in zip(*self.parts, strict=True)]
            yield from pa.table([*columns, pa.array(self.counts)], names=self.NAMES).to_batches(65_536)


def counted(docs: DataFrame, hashes: DataFrame, failed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f): phrases whose hash is one of ``hashes`` or that extend those of ``failed``, by themselves, ``least`` occurrences or more.

    A phrase of no words for each language counts all of its words.
    """
    none = failed.isEmpty()
    packed = docs.sparkSession.sparkContext.broadcast((bits_for(hashes).packed, None if none else bits_for(failed).packed))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, extend = (None if x is None else Bits(x) for x in packed.value)
        tally = Tally()
        for langs, stretch in _stretches(batches):
            own, place = np.unique(np.array(langs, object), return_inverse=True)
            totals = np.bincount(place[stretch.owner], minlength=len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), pa.array([""] * len(own)), pa.array(np.zeros(len(own), np.int32)), pa.array(totals)], Tally.NAMES
            )
            tally.add(langs, stretch, list(extended(stretch, frequent, extend)))
            if tally.full:
                yield from tally.batches()
                tally = Tally()
        yield from tally.batches()

    found = _texts(docs).mapInArrow(rows, "lang string, phrase string, words int, n long")
    sums = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return stage(sums.where((F.col("f") >= least) | (F.col("words") == 0)), "counts")


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): every phrase with ``least`` occurrences in its language, exactly counted.

    Phrases of no words carry the number of all words of their language.
    """
    docs = docs.select("doc_id", "lang", "text")
    size, segments = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1
    while segments * SEGMENT_TEXT < size:
        segments *= 2
    now, before, found = proposals(docs, segments), None, None
    while True:
        hashes = border_pass(docs, now, before, least, segments)
        found = hashes if found is None else found.unionByName(hashes)
        failed = failures(hashes, now)
        if failed.count() * FEW <= found.count():
            return counted(docs, found, failed, least)
        now, before = Bits(now.packed | set_bits(failed, now.size).packed), now


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): phrases of two words and more by their lowest-scoring cut, contained ones left out."""
    many = found.where("words >= 2").withColumnRenamed("f", "a")
    cuts = many.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).selectExpr(
        "*", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - words) AS rest"
    )
    parts = found.where("words >= 1")
    left = parts.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left.withColumnRenamed("l_lang", "lang"), ["lang", "first"]).join(right.withColumnRenamed("r_lang", "lang"), ["lang", "rest"])
    # Decimals: two million times a count may pass 64 bits.
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = many.where("words >= 3").selectExpr(
        "lang",
        "a AS longer",
        "explode(flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, n), ' '))))) AS phrase",
    )
    within = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    contained = F.expr(f"coalesce(cast(longer AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {CONTAINED}, false)")
    return best.join(within, ["lang", "phrase"], "left").where(~contained).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def top_phrases(docs: DataFrame, least: int = LEAST, keep: int = KEEP, group_rows: int = 50_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``keep`` phrases of each language.

    A null language counts as ``und``, a null text as empty; repeated rows count as often as they are there; further columns are left
    out. Languages without frequent phrases have no rows, and an empty table has none.
    """
    found = frequent(docs, least)
    best = stage(scored(found), "scored")
    # No window holds a whole language: the best of hashed groups first, then the best of those.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    group_rows = max(group_rows, 2 * keep)
    groups = max(1, best.count() // group_rows)
    while groups > 1:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= keep).drop("rank")
        groups = groups * keep // group_rows
    total = found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
    SELECT lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM words, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}),
often AS (SELECT lang, phrase, f FROM f WHERE f >= {LEAST}),
places AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM c JOIN (VALUES (1), (2), (3)) AS s(k) ON k < m
), cuts AS (
    SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r, ((a::HUGEINT * 2000000) // (l.f::HUGEINT + r.f))::BIGINT AS score
    FROM places p JOIN often l ON l.lang = p.lang AND l.phrase = p.head JOIN often r ON r.lang = p.lang AND r.phrase = p.tail
), best AS (
    SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
    SELECT lang, a AS longer, unnest(list_transform(generate_series(1, m - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM c, (VALUES (2), (3)) AS t(size) WHERE size < m
), inside AS (SELECT lang, phrase, max(longer) AS longer FROM parts GROUP BY ALL),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM best LEFT JOIN inside USING (lang, phrase)
    WHERE coalesce(longer::HUGEINT * 100 < a::HUGEINT * {CONTAINED}, true)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {KEEP}
"""
