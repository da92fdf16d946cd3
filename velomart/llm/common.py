"""What several operators share: staged tables, opaque files, tokenizer input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.sinks.tables import work_folder

PAD = "\u0000"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once below the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Write each value of the one binary column ``blob`` as a file of its own.

    Goes through Spark's file commit, so any Hadoop file system will do and a repeated task
    leaves nothing behind. The text writer ends each file with one zero byte of padding.
    """
    (
        blobs.select(F.col("blob").cast("string").alias("value"))
        .write.option("lineSep", PAD)
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, blob): the files that ``write_blobs`` left, padding included."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", F.col("content").alias("blob"))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small batches, so that a worker holds few texts as Python objects at a time; unused memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``key`` alone; never more than twice as many."""
    total = df.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, total)))
    return df.where(share).limit(2 * rows)
