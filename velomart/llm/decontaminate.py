"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Of the hashes of the ``GRAM``-word grams in each window the smallest is its fingerprint. Equal windows have equal
fingerprints, so joining the fingerprints of documents and items finds every shared span of ``WINDOW`` words, and
keeps about a fifth of the grams. Texts that share one are then extended: their windows are joined with those
of the items, and the words under any of them are hit.

All of it is DataFrame functions. What is found depends on the text alone, so it is worked out per distinct text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import stage

WINDOW, GRAM = 13, 5
#: A document is contaminated if one word in so many is hit, or more.
SHARE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and no other letter; null has none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _grams(hashes: Column, width: int) -> Column:
    """The hash of each gram of ``width`` words, from the words' hashes; ``width`` words at least."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - width),
        lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)]),
    )


def _fingerprints(hashes: Column) -> Column:
    """The fingerprint of each window; ``WINDOW`` words at least."""
    run = WINDOW - GRAM + 1
    return _let(
        _grams(hashes, GRAM),
        lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - run), lambda i: F.least(*[F.get(g, i + k) for k in range(run)])),
    )


NONE = "cast(array() as array<bigint>)"


def _from(hashes: Column, least: int, made: Column) -> Column:
    return F.when(F.size(hashes) >= least, made).otherwise(F.expr(NONE))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, width, fingerprint, window): one row per window; the fingerprint of a short one is its own hash."""
    hashed = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"),
    ).where("size(h) > 0")
    long = hashed.where(F.size("h") >= WINDOW).select(
        "item",
        F.lit(WINDOW).alias("width"),
        F.explode(F.arrays_zip(_fingerprints(F.col("h")).alias("f"), _grams(F.col("h"), WINDOW).alias("w"))).alias("x"),
    )
    short = [
        hashed.where(F.size("h") == n).select("item", F.lit(n).alias("width"), F.get(_grams(F.col("h"), n), F.lit(0)).alias("window"))
        for n in _short_lengths(hashed)
    ]
    found = long.select("item", "width", F.col("x.f").alias("fingerprint"), F.col("x.w").alias("window"))
    for part in short:
        found = found.unionByName(part.withColumn("fingerprint", F.col("window")))
    return found


def _short_lengths(hashed: DataFrame) -> list[int]:
    """Which numbers of words below ``WINDOW`` items have: a dozen at most."""
    rows = hashed.where(F.size("h") < WINDOW).select(F.size("h").alias("n")).distinct().collect()
    return sorted(r["n"] for r in rows)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``docs``.

    Null and empty texts have no words; items without words match nothing; an empty benchmark hits nothing.
    Items are counted by item_id, a null one as the empty string; further columns are left out.
    """
    items = stage(item_windows(benchmark.select("item_id", "text")), "items")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # a dozen at most
    short = sorted(w for w in widths if w < WINDOW)
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))

    def prints(h: Column) -> Column:
        parts = [_from(h, WINDOW, _fingerprints(h)), *[_from(h, n, _grams(h, n)) for n in short]]
        return F.struct(F.size(h).cast("long").alias("n_words"), F.array_distinct(F.concat(*parts)).alias("prints"))

    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = stage(keyed.select("doc_id", "text_key", _let(hashed, prints).alias("p")).select("doc_id", "text_key", "p.*"), "prints")
    shared = (
        rows.select("text_key", F.explode("prints").alias("fingerprint"))
        .join(items.select("fingerprint").distinct(), "fingerprint", "left_semi")
        .select("text_key")
        .distinct()
    )
    # Only texts that share a fingerprint are read again, each once.
    texts = (
        keyed.join(stage(shared, "shared"), "text_key", "left_semi")
        .dropDuplicates(["text_key"])
        .select("text_key", hashed.alias("h"))
    )
    windows = None
    for width in widths:
        part = texts.where(F.size("h") >= width).select("text_key", F.lit(width).alias("width"), F.posexplode(_grams(F.col("h"), width)).alias("at", "window"))
        windows = part if windows is None else windows.unionByName(part)
    if windows is None:
        windows = texts.selectExpr("text_key", "0 AS width", "0 AS at", "0L AS window").where("false")
    hits = stage(windows.join(items.select("item", "width", "window").distinct(), ["width", "window"]).select("text_key", "item", "at", "width"), "hits")
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["at"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")
        ),
    )
    # One row per text and place, so a passage that many items share counts once; at most the words of a text.
    n_hit = (
        hits.groupBy("text_key", "at")
        .agg(F.max(F.col("at") + F.col("width")).alias("end"))
        .groupBy("text_key")
        .agg(covered["n"].cast("long").alias("n_hit"))
    )
    matched = (
        hits.groupBy("text_key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("text_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    )
    found = n_hit.join(matched, "text_key")
    zero = F.lit(0).cast("long")
    return (
        rows.drop("prints")
        .join(found, "text_key", "left")
        .withColumns(
            {
                "n_hit": F.coalesce("n_hit", zero),
                "n_items": F.coalesce("n_items", zero),
                "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)),
            }
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    )


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("text_key").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(stage(bad, "contaminated"), F.col("key") == F.col("bad"), "left_anti").select("row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM bs
), ds AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM ds
), h AS (
  SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, g)
), p AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
