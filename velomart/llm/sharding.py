"""Proportional stratified interleaving: rows into equal shards that each hold the whole mixture.

Rows are shuffled by a seeded hash and ranked within their source; row r (from 1) of a source of n stands at
the fraction (r - 1 + u) / n of the whole. u spreads the sources of one size evenly, in the order of a seeded
hash: source s (from 1) of c such sources has u = (2s - 1) / 2c. So a thousand sources of one row stand
as evenly as a thousand rows of one source. Sorted by the fraction, every stretch holds each source, and the small
ones together, in their share, and equal stretches are the shards. Law ``rows``: shard sizes differ by one row at most.

Both numberings, within a source and over all rows, are done in groups of about ``GROUP_ROWS`` that are
cut by value, each starting where those before it end; a source may hold any share of the rows, and so may
sources of one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velomart.llm.common import stage

SHARDS, SEED = 40, 7
#: Rows that one window group holds at most, about.
GROUP_ROWS = 5_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def _before(count: str, key: str, by: list[str]) -> Column:
    rows = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(rows), F.lit(0))


def described(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shuffled): one narrow row per document.

    Null text: no bytes. A null source is a source of its own. ``shuffled``: 16 hexadecimal digits.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _hashed(seed, F.col("doc_id").cast("string"), F.crc32(text.cast("binary")).cast("string")).alias("shuffled"),
    )


def _hashed(seed: int, *parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, 16)


def ranked(rows: DataFrame, total: int, within: str, ties: list[str]) -> DataFrame:
    """Adds ``place`` (from 1, by ``shuffled`` among the rows of equal ``within``) and ``of`` (how many these are)."""
    digits = max(0, math.ceil(math.log(max(1, total / GROUP_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("shuffled", 1, digits) if digits else F.lit(""))
    groups = (
        rows.groupBy(within, "bucket")
        .agg(F.count("*").alias("n"))
        .select(
            F.col(within).alias("of_within"),
            F.col("bucket").alias("of_bucket"),
            _before("n", "bucket", [within]).alias("before"),
            F.sum("n").over(Window.partitionBy(within)).alias("of"),
        )
    )
    own = Window.partitionBy(within, "bucket").orderBy("shuffled", *ties)
    return (
        rows.withColumn("row", F.row_number().over(own))
        .join(groups, F.col(within).eqNullSafe(F.col("of_within")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("place", F.col("before") + F.col("row"))
        .drop("bucket", "of_within", "of_bucket", "row", "before")
    )


def offsets(rows: DataFrame, seed: int) -> DataFrame:
    """(u_source, u): where in the step of its source a row stands; sources of one size share the step evenly."""
    sources = rows.groupBy("source").agg(F.count("*").alias("size"))
    # A null source is told apart from one of an empty name.
    sources = stage(sources.withColumn("shuffled", _hashed(seed, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), "sources")
    places = ranked(sources, sources.count(), "size", ["source"])
    return places.select(F.col("source").alias("u_source"), ((2 * F.col("place") - 1).cast("double") / (2 * F.col("of")).cast("double")).alias("u"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): every document once, slots gapless from 0.

    Depends on the rows and the seed only, not on partitions or row order; rows that are equal in all
    of doc_id, source and text are interchangeable. An empty table gives an empty result; further
    columns are left out.
    """
    # Read several times below: its sources and cells are counted, its rows numbered.
    rows = stage(described(docs, seed), "described")
    total = rows.count()
    numbered = ranked(rows, total, "source", ["doc_id", "text_crc32", "size"])
    steps = stage(offsets(rows, seed), "offsets")
    placed = stage(
        numbered.join(steps, F.col("source").eqNullSafe(F.col("u_source")))
        .withColumn("fraction", (F.col("place") - 1 + F.col("u")) / F.col("of").cast("double"))
        .drop("u_source", "u"),
        "ranked",
    )
    cells = max(1, math.ceil(total / GROUP_ROWS))
    placed = placed.withColumn("cell", F.floor(F.col("fraction") * cells))
    per_cell = placed.groupBy("cell").agg(F.count("*").alias("n"))
    # One row per cell, of some thousand rows each.
    starts = per_cell.withColumn("block", F.expr("cell div 4096")).withColumn("in_block", _before("n", "cell", ["block"]))
    blocks = per_cell.groupBy(F.expr("cell div 4096").alias("block")).agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("blocks_before", _before("n", "block", [])).drop("n")
    starts = starts.join(blocks, "block").select("cell", (F.col("in_block") + F.col("blocks_before")).alias("start"))
    order = Window.partitionBy("cell").orderBy("fraction", "source", "place")
    return (
        placed.withColumn("row", F.row_number().over(order) - 1)
        .join(starts, "cell")
        .withColumn("position", F.col("start") + F.col("row"))
        .withColumn("shard", F.expr(f"cast((position * {shards}L) div {max(1, total)}L as int)"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )

