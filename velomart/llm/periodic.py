"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, of ``LEAST`` words and ``TIMES`` periods at least,
that no neighbouring word extends. For every power of two L the dictionary names the factors of L words, a name
of 2L being a pair of names of L; factors that occur once in their text are left out, as no longer one of them
recurs. Let L be the power of two with L/2 < q <= L: inside a run of period q every factor of L words comes
again after q words and not before, so the places with successor distance q, both occurrences within a
stretch of 2L words, stand next to each other and form an arithmetic progression. Each such group of places proposes a run,
which is extended by comparing words and kept once.

Texts are worked on alone, a stretch of them at a time; words are compared as such, never by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import slices
from velomart.llm.words import by_size

LEAST, TIMES = 6, 4
SPACE = r"[\x20\x09-\x0D]+"


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts in a row as numbers; equal words have equal numbers within a text, and only there."""
    out, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((base + known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        base += len(known)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs in texts that ``numbered`` put in a row, by start and period.

    Places count over all texts. ``times`` is 3 at least: shorter runs need not hold the factors that propose them.
    """
    sizes = np.asarray(sizes, np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins, of_text = ends - np.repeat(sizes, sizes), np.repeat(sizes, sizes)
    found = [np.zeros((0, 3), np.int64)]
    name = np.full(len(codes), -1, np.int64)
    at, value, length = np.arange(len(codes)), codes, 1
    while len(at):
        order = np.argsort(value, kind="stable")
        place, value = at[order], value[order]
        same = np.append(value[1:] == value[:-1], False)
        gap = np.where(same, np.append(place[1:], 0) - place, 0)
        found.append(_extended(codes, begins, ends, *_progressions(place, gap, length, least, times)))
        # One level up: factors that recur, from two halves that recur, in texts with room for so long a period.
        recurs = same | np.append(False, same[:-1])
        name[at] = -1
        name[place[recurs]] = np.cumsum(np.append(True, ~same[:-1]))[recurs]
        at = np.sort(place[recurs])
        at = at[(at + 2 * length <= ends[at]) & (of_text[at] >= times * (length + 1))]
        at = at[name[at + length] >= 0]
        value = name[at] * (len(codes) + 1) + name[at + length]
        length *= 2
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _progressions(place: np.ndarray, gap: np.ndarray, length: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) proposed by neighbouring places with one successor distance of this level."""
    near = np.flatnonzero((gap > length // 2) & (gap <= length))
    near = near[np.argsort(place[near])]
    place, gap = place[near], gap[near]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (gap[1:] != gap[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    start, period = place[first], gap[first]
    end = place[last] + length + period
    long = end - start >= np.maximum(least, times * period)
    return start[long], end[long], period[long]


def _extended(codes, begins, ends, start, end, period) -> np.ndarray:
    """Rows (start, period, end) of stretches that no neighbouring word extends."""
    text_begin, text_end = begins[start], ends[start]
    while True:
        left = np.flatnonzero(start > text_begin)
        left = left[codes[start[left] - 1] == codes[start[left] - 1 + period[left]]]
        right = np.flatnonzero(end < text_end)
        right = right[codes[end[right]] == codes[end[right] - period[right]]]
        if not len(left) and not len(right):
            return np.stack([start, period, end], axis=1)
        start[left] -= 1
        end[right] += 1


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of ``docs``, further columns left out.

    ``runs``: (start, length, period) of every run by start and period, in words from 0. ``collapsed``: the words
    joined by one space, without those that some run holds after its first period. A null or empty text has no
    words, no runs and an empty ``collapsed``; null and repeated doc_ids are carried through. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for part in by_size(texts, 1_000_000):
                words = [(t or "").encode().split() for t in texts[part]]
                sizes = np.array([len(w) for w in words], np.int64)
                begin = np.cumsum(sizes) - sizes
                all_runs = runs(numbered(words), sizes)
                start, end, period = all_runs.T
                turn = np.zeros(int(sizes.sum()) + 1, np.int64)
                np.add.at(turn, start + period, 1)
                np.add.at(turn, end, -1)
                kept = np.cumsum(turn)[:-1] <= 0
                left = [
                    b" ".join(w if kept[a : a + len(w)].all() else [x for x, k in zip(w, kept[a : a + len(w)], strict=True) if k])
                    for w, a in zip(words, begin, strict=True)
                ]
                edges = np.append(np.searchsorted(start, begin), len(start)).astype(np.int32)
                own = begin[np.repeat(np.arange(len(sizes)), np.diff(edges))]
                values = pa.StructArray.from_arrays([pa.array(c) for c in (start - own, end - start, period)], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part.start : part.stop],
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(edges), values),
                        pa.array([x.decode() for x in left], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The texts of the contract: one document in ten repeats a stretch of its words to its end.

    Chosen, and the stretch with it, by the crc32 of the decimal doc_id; a null doc_id is never chosen.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, SPACE), "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = F.sequence(F.lit(0), n - 1)
        moved = F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(text)

    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def reported(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of what is left, per document."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.short")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.short)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
