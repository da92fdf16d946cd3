"""Best-fit packing: token pieces into as few sequences of one capacity as it can.

Large-item matching. Pieces above a third of the capacity share a sequence with at most one
other such piece: from the longest down, each is matched with the longest partner that still
fits. Smaller pieces then fill the remaining gaps by best fit, longest first.

Lengths are whole numbers up to the capacity, so the plan is worked out on their counts: the
driver sees at most ``capacity`` numbers, and the plan has a few entries per length however
many pieces there are. Pieces find their place by rank among those of their length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velomart.llm.common import slices, stage
from velomart.llm.tokens import UnitEncoder

CAPACITY = 2048
#: Pieces that one window group of ``ranked`` holds at most, about.
GROUP_ROWS = 20_000


@dataclass
class Placement:
    """``bins`` sequences from ``sequence`` on, each with ``copies`` pieces of ``length`` from ``offset`` on.

    They take the pieces of that length whose ranks start at ``rank``.
    """

    length: int
    rank: int
    copies: int
    bins: int
    sequence: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int) -> list[Placement]:
    """The plan for ``counts`` pieces per length. Work and size depend on ``capacity`` only."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    third = capacity // 3
    gaps: dict[int, list] = {}  # gap -> groups of (bins, ((length, copies), ...))
    order: list[int] = []  # the gaps there are, ascending

    def put(gap: int, bins: int, content: tuple) -> None:
        if bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((bins, content))

    for a in range(capacity, third, -1):
        while left[a]:
            most = min(capacity - a, a)
            fits = np.flatnonzero(left[third + 1 : most + 1]) if most > third else []
            if len(fits) and (b := int(fits[-1]) + third + 1) == a and left[a] == 1:
                fits = fits[:-1]
            if not len(fits):
                put(capacity - a, int(left[a]), ((a, 1),))
                left[a] = 0
            elif (b := int(fits[-1]) + third + 1) == a:
                pairs = int(left[a]) // 2
                put(capacity - 2 * a, pairs, ((a, 2),))
                left[a] -= 2 * pairs
            else:
                pairs = int(min(left[a], left[b]))
                put(capacity - a - b, pairs, ((a, 1), (b, 1)))
                left[a] -= pairs
                left[b] -= pairs

    for s in range(third, 0, -1):
        while rest := int(left[s]):
            at = bisect_left(order, s)
            gap = order[at] if at < len(order) else capacity
            if at < len(order):
                bins, content = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                bins, content = math.ceil(rest / (capacity // s)), ()
            per = gap // s
            full = min(bins, rest // per)
            last = min(per, rest - full * per) if full < bins else 0
            put(gap - per * s, full, (*content, (s, per)))
            if last:
                put(gap - last * s, 1, (*content, (s, last)))
            put(gap, bins - full - bool(last), content)
            left[s] -= full * per + last

    plan, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for gap in sorted(gaps):
        for bins, content in gaps[gap]:
            offset = 0
            for length, copies in content:
                plan.append(Placement(length, used[length], copies, bins, sequence, offset))
                used[length] += copies * bins
                offset += length * copies
            sequence += bins
    return plan


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, leading_space: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and the end id, cut at ``capacity``.

    Null text: the end id alone. ``ids``: little-endian unsigned 32-bit. Rows with the same
    doc_id are documents of their own; further columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of_worker(tokenizer, leading_space, end_id)
        for batch in slices(batches):
            rows, piece, start, ids = [], [], [], []
            for row, whole in enumerate(encoder.encode(batch.column("text").to_pylist())):
                for k, at in enumerate(range(0, len(whole), size)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    ids.append(whole[at : at + size])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: gapless from 0 among the pieces of one length.

    A length may hold any share of the rows, so it is numbered in salted groups of about
    ``GROUP_ROWS``, and each group starts where those before it end.
    """
    salts = max(1, math.ceil(total / GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    within = Window.partitionBy("length", "salt").orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns])
    return (
        salted.withColumn("row", F.row_number().over(within))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("row") - 1)
        .drop("salt", "before", "row")
    )


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``; ids are not touched.

    An empty frame stays empty. Equal rows get places of their own.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(plan_packing(counts, capacity), key=lambda p: (p.length, p.rank))
    # A few entries per length, whatever the number of pieces: bounded by the capacity.
    entries = spark.sparkContext.broadcast(
        {k: np.array([getattr(p, k) for p in plan], np.int64) for k in Placement.__dataclass_fields__}
    )
    base = ranked(pieces, sum(counts.values()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = entries.value
        first = (e["length"] << 44) | e["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(first, (length << 44) | rank, "right") - 1
            if len(at):
                turn = rank - e["rank"][at]
                bin_, copy = np.divmod(turn, e["copies"][at])
                sequence, offset = e["sequence"][at] + bin_, e["offset"][at] + copy * length
            else:
                sequence = offset = np.zeros(0, np.int64)
            keep = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(sequence), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "rank")
    return base.mapInArrow(look_up, schema + ", sequence_id long, offset long")


@dataclass
class Packing:
    """``pieces``: written, with their ids. ``places``: the same rows without ids, with sequence_id and offset."""

    pieces: DataFrame
    places: DataFrame

    def sequences(self) -> DataFrame:
        """(sequence_id, length, doc_ids, ids): each sequence put together, at most ``capacity`` ids."""
        one = self.pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).select(
            F.col("doc_id").alias("_doc"), F.col("piece").alias("_piece"), F.col("ids_crc32").alias("_crc"), "ids"
        )
        on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("piece") == F.col("_piece")) & (F.col("ids_crc32") == F.col("_crc"))
        parts = self.places.join(one, on).select("sequence_id", F.struct("offset", "doc_id", "length", "ids").alias("part"))
        return (
            parts.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list("part")).alias("parts"))
            .select(
                "sequence_id",
                F.expr("aggregate(parts.length, 0L, (a, x) -> a + x)").alias("length"),
                F.col("parts.doc_id").alias("doc_ids"),
                F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"),
            )
        )


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> Packing:
    """Tokenize, cut and place whole documents. Tokenized once: the pieces are written and read back."""
    pieces = stage(
        token_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")), "pieces"
    )
    return Packing(pieces, place(pieces.drop("ids"), capacity))
