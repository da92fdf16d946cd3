"""Near-duplicate documents by ProbMinHash.

A document is the set of its five-word shingles. Every shingle sends a Poisson stream of arrivals at the rate
of its weight, each arrival to a random register; a register keeps the shingle that reached it first, and a
stream ends when it can reach no register earlier. Two documents agree in a register with the probability
Jaccard similarity of their weights. All weights are 1, so that this is the similarity by which links are
judged, however often either text repeats a passage. Registers in bands give buckets of
candidates; a candidate pair is a link if the Jaccard similarity of its shingle sets is ``THRESHOLD`` or more.

Documents of equal text are one class from the start. Classes of linked texts are found bucket by
bucket without all pairs of a bucket: everything is compared with the bucket's first text, and where that leaves several classes
with the text in the middle; then, round by round, only texts whose class still differs from others of their bucket are compared with those, in blocks, and only
where a link is possible. That is decided by what sets a text apart from the majority of its bucket, see ``distances``; the
bound is exact, so no link between texts that share a bucket is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velomart.llm.common import slices, stage
from velomart.llm.words import RunHasher, by_size, mixed, of_worker

SHINGLE, THRESHOLD = 5, 0.8
#: 16 bands of 4 registers: a pair at 0.8 shares a band with probability 0.9998, one at 0.3 with 0.12.
BANDS, ROWS = 16, 4
#: Texts of a bucket that one round holds against the rest of it: so many comparisons at most, but 8 texts at least.
ROUND_COMPARISONS = 1_000_000
ID_BITS = np.uint64((1 << 24) - 1)
NEVER = np.uint64(0x7FF0000000000000)  # infinity as a 64-bit float
STREAM = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of texts given as word hashes in a row.

    A text of fewer words, but not none, is one shingle.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = np.repeat(sizes, sizes) - place
    value = np.zeros(len(words), np.uint64)
    for k in range(width):
        following = np.zeros_like(words)
        if k < len(words):
            following[: len(words) - k] = words[k:]
        value = mixed(np.where(rest > k, following, np.uint64(0)) + value * STREAM + np.uint64(k))
    first = (rest >= width) | (place == 0)
    owner, value = owner[first], value[first]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def sketches(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of each text: the 24 low bits of the shingle that reached each register first.

    A register keeps arrival time and shingle in one number, whose order is that of the times. Rows of
    texts without shingles are meaningless.
    """
    best = np.full(texts * registers, NEVER)
    latest = np.full(texts, np.inf)
    time = np.zeros(len(value))
    turn = 0
    while len(value):
        turn += 1
        random = mixed(value + np.uint64(turn * int(STREAM) % (1 << 64)))
        time = time - np.log((random >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        going = time < latest[owner]
        owner, value, weight, time, random = owner[going], value[going], weight[going], time[going], random[going]
        register = (mixed(random) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, owner * registers + register, (time.view(np.uint64) & ~ID_BITS) | (value & ID_BITS))
        latest = (best.reshape(texts, registers).max(axis=1) & ~ID_BITS).view(np.float64)
    return (best & ID_BITS).reshape(texts, registers)


def bands(found: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` registers, different from band to band."""
    value = np.zeros((len(found), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        value = mixed(value * STREAM + found[:, k::ROWS])
    return value.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, shingles, bands): one row per document; null text counts as empty, and has no bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for part in by_size(texts, 1_000_000):
                found = of_worker("words", RunHasher).words(texts[part])
                sizes = found.sizes
                owner, value, _ = shingles(found.hashes, sizes)
                hashed = bands(sketches(owner, value, np.ones(len(value)), len(sizes)))
                distinct = np.bincount(owner, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part.start : part.stop],
                        batch.column("text_key")[part.start : part.stop],
                        pa.array(distinct.astype(np.int32)),
                        pa.array([b if n else [] for b, n in zip(hashed, distinct, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "shingles", "bands"],
                )

    return with_key(docs).select("doc_id", "text", "text_key").mapInArrow(
        rows, f"doc_id {kind}, text_key long, shingles int, bands array<long>"
    )


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(text_key, set): the distinct shingles of each distinct text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for part in by_size(texts, 1_000_000):
                found = of_worker("words", RunHasher).words(texts[part])
                sizes = found.sizes
                owner, value, _ = shingles(found.hashes, sizes)
                ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_key")[part.start : part.stop], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))],
                    ["text_key", "set"],
                )

    return docs.select("text", "text_key").mapInArrow(rows, "text_key long, set array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity): the Jaccard similarity of the shingle sets of each pair of texts."""
    a, b = (sets.select(F.col("text_key").alias(k), F.col("set").alias(f"{k}_set")) for k in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b", (both / (F.size("a_set") + F.size("b_set") - both)).alias("similarity")
    )


def distances(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(ref, text_key, apart, shared): for the texts of each group, given as (ref, text_key), what sets them apart.

    Let M be the shingles that more than half of a group's texts have, and D the difference between a text's
    set and M. ``apart`` is the size of D, ``shared`` how many shingles of D another text's difference may have too: those
    that M has, and those that at least one more text has. Two sets A and B differ in apart(A) + apart(B) - 2 |D(A) and D(B)|
    shingles, and the last is at most the smaller ``shared``. In a group of near copies most of what sets a copy apart is its own.
    """
    has = groups.join(sets, "text_key").select("ref", "text_key", F.explode("set").alias("shingle"))
    sizes = groups.groupBy("ref").agg(F.count("*").alias("texts"))
    common = (
        has.groupBy("ref", "shingle")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .join(sizes, "ref")
        .select("ref", "shingle", F.expr("int(2 * n > texts)").alias("major"))
    )
    common = stage(common, "common")
    majors = common.groupBy("ref").agg(F.sum("major").alias("majors"))
    held = has.join(common, ["ref", "shingle"]).groupBy("ref", "text_key").agg(F.count("*").alias("common"), F.sum("major").alias("major"))
    whole = sets.select("text_key", F.size("set").alias("size"))
    found = groups.join(whole, "text_key").join(majors, "ref", "left").join(held, ["ref", "text_key"], "left").fillna(0)
    return found.select(
        "ref",
        "text_key",
        F.expr("size + majors - 2 * major").alias("apart"),
        F.expr("common + majors - 2 * major").alias("shared"),
    )


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(text_key, class) after ``links`` between texts: the smallest label of what hangs together.

    Labels move along links and then jump to their label's label, until none changes; every round is written.
    """
    ends = labels.withColumnRenamed("text_key", "a").withColumnRenamed("class", "x")
    edges = links.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").where("x <> y")
    edges = stage(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    to = edges.select(F.col("x").alias("class")).distinct().withColumn("to", F.col("class"))
    while True:
        near = edges.join(to.select(F.col("class").alias("y"), F.col("to").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        moved = to.join(near, to["class"] == near["x"]).select("class", F.col("to").alias("old"), F.least("to", "near").alias("to"))
        jump = moved.select(F.col("class").alias("via"), F.col("to").alias("further"))
        after = stage(
            moved.join(jump, moved["to"] == jump["via"]).select("class", "old", F.least("to", "further").alias("to")), "labels"
        )
        to = after.select("class", "to")
        if after.where("`old` <> `to`").isEmpty():
            break
    return stage(
        labels.join(to, "class", "left").select("text_key", F.coalesce("to", "class").alias("class")), "classes"
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class, class_id): one row per row of ``docs``; ``class_id`` is the smallest doc_id of its class.

    Equal texts (null and empty ones too) are one class, whatever their size. Null doc_ids are no
    class_id unless a class has no other. An empty table gives an empty result; further columns are left out.
    """
    rows = stage(sketched(docs.select("doc_id", "text")), "sketches")
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    members = texts.select("text_key", "shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = (
        members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("text_key").alias("a")).where("n > 1")
    )
    members = stage(members.join(crowded, ["band", "bucket"]), "buckets")
    labels = members.select("text_key").distinct().withColumn("class", F.col("text_key"))
    sets = stage(
        shingle_sets(
            with_key(docs.select("doc_id", "text")).join(members.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])
        ),
        "sets",
    )
    # Every text of a bucket with its first text.
    pairs = members.where("text_key <> a").select("a", F.col("text_key").alias("b")).distinct()
    first = stage(compared(pairs, sets), "first")
    labels = joined_classes(stage(labels, "labels"), first.where(F.col("similarity") >= threshold).select("a", "b"))
    left = members.where("text_key <> a").withColumnRenamed("a", "ref")
    bucket = ["band", "bucket"]
    # Sets of m and n shingles are a link if they differ in (m + n) * most or fewer.
    most = (1 - threshold) / (1 + threshold) + 1e-9
    near = (
        f"least(shingles, a_shingles) >= {threshold} * greatest(shingles, a_shingles)"
        f" AND apart + a_apart - 2 * least(shared, a_shared) <= (shingles + a_shingles) * {most}D"
    )
    while True:
        now = left.join(labels, "text_key")
        split = now.groupBy(*bucket).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select(*bucket)
        now = stage(now.join(split, bucket), "left")
        if now.isEmpty():
            break
        if "apart" not in now.columns:
            known = stage(distances(now.select("ref", "text_key").distinct(), sets), "distances")
            # The text nearest to the majority is the best one to be compared with, one pair per text.
            centre = known.groupBy("ref").agg(F.min(F.struct("apart", "text_key")).alias("c")).selectExpr("ref", "c.text_key AS a")
            pairs = known.join(centre, "ref").where("a <> text_key").select("a", F.col("text_key").alias("b")).distinct()
            links = compared(pairs, sets).where(F.col("similarity") >= threshold).select("a", "b")
            labels = joined_classes(labels, links)
            left = left.join(known, ["ref", "text_key"])
            continue
        per_class = now.groupBy(*bucket, "class").agg(F.count("*").alias("of_class"))
        main = per_class.groupBy(*bucket).agg(F.max(F.struct("of_class", "class")).alias("main")).select(*bucket, F.col("main.class").alias("main"))
        # What no other text can have in common with a text is too much already, even beside the largest and closest of the bucket.
        best = now.groupBy(*bucket).agg(F.max("shingles").alias("largest"), F.min(F.col("apart") - F.col("shared")).alias("closest"))
        apart = (
            now.join(main, bucket)
            .where("class <> main")
            .join(best, bucket)
            .where(f"apart - shared + closest <= (shingles + largest) * {most}D")
        )
        # Texts outside their bucket's main class are few, or the bucket is; both are numbered block by block.
        turn = F.row_number().over(Window.partitionBy(*bucket).orderBy("text_key"))
        block = apart.withColumn("turn", turn).where(f"turn <= greatest(8, {ROUND_COMPARISONS} div n)")
        block = stage(
            block.select(*bucket, *[F.col(c).alias(to) for c, to in (("text_key", "a"), ("class", "a_class"), ("shingles", "a_shingles"), ("apart", "a_apart"), ("shared", "a_shared"))]),
            "block",
        )
        if block.isEmpty():
            break
        pairs = (
            now.join(block, bucket)
            .where(f"class <> a_class AND {near}")
            .select(F.least("a", "text_key").alias("a"), F.greatest("a", "text_key").alias("b"))
            .distinct()
        )
        links = compared(pairs, sets).where(F.col("similarity") >= threshold).select("a", "b")
        labels = joined_classes(labels, links)
        left = now.drop("class").join(block.select(*bucket, F.col("a").alias("text_key")), [*bucket, "text_key"], "left_anti")

    whole = texts.select("text_key", "doc_id").join(labels, "text_key", "left").withColumn("class", F.coalesce("class", "text_key"))
    names = whole.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = whole.join(names, "class").select("text_key", "class", "class_id")
    return rows.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "class", "class_id")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class: the one with the smallest doc_id.

    Of rows that repeat this doc_id, the first by text stays, once.
    """
    found = stage(classes(docs, threshold), "found").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = found.groupBy("class").agg(F.min("text_key").alias("text_key"))
    keep = found.join(first, ["class", "text_key"]).groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    keep = stage(keep.select(F.col("doc_id").alias("keep_id"), F.col("text_key").alias("keep_key"), "times"), "keep")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    at = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    once = rows.join(keep.where("times = 1"), at, "left_semi").select("row.*")
    repeated = keep.where("times > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(rows.join(repeated, at, "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*"))
