"""Column profiles that can be merged: one distinct-count sketch per partition and column.

The exact profile (``aggregates.table_profile``) shuffles every distinct value of a table, each time. Here each partition
keeps sketches, a fixed number of bytes per column; profiles of a table or any range of its partitions are
merged from them, and after a load only partitions whose files changed are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velomart.operators.aggregates import as_text
from velomart.sinks.tables import publish, published, read_published, staged

#: Binary logarithm of the registers of a sketch: 16 KB at most per partition and column.
LOG2_REGISTERS = 14

STORED = "partition_value string, state long, column_name string, present long, sketch binary"


def error_bound(log2_registers: int = LOG2_REGISTERS, deviations: float = 4) -> float:
    """Relative error of a merged distinct count that is exceeded once in 16,000 (at four deviations)."""
    return deviations * 1.04 / 2 ** (log2_registers / 2)


def _hashable(df: DataFrame, name: str) -> Column:
    """Whole numbers, texts and bytes go into a sketch as they are, all else as the text that exact counts use."""
    kind = df.schema[name].dataType
    plain = isinstance(kind, T.IntegerType | T.LongType | T.StringType | T.BinaryType)
    return F.col(f"`{name}`") if plain else as_text(df, name)


def partition_sketches(df: DataFrame, partition: str, log2_registers: int = LOG2_REGISTERS) -> DataFrame:
    """(partition_value, column_name, present, sketch) of every other column: one pass, one row per partition and task shuffled.

    ``partition_value`` is the partition as text, NULL for the NULL partition. ``present`` counts values that are not
    NULL; a column without any has an empty sketch. An empty table has no rows.
    """
    names = [name for name in df.columns if name != partition]
    wanted = [F.count(F.col(f"`{name}`")).alias(f"n{i}") for i, name in enumerate(names)]
    wanted += [F.hll_sketch_agg(_hashable(df, name), F.lit(log2_registers)).alias(f"s{i}") for i, name in enumerate(names)]
    found = df.groupBy(F.col(f"`{partition}`").cast("string").alias("partition_value")).agg(*wanted)
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("present"), F.col(f"s{i}").alias("sketch"))
            for i, name in enumerate(names)
        ]
    )
    return found.select("partition_value", F.inline(listed))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(column_name, present, distinct_estimate) over all partitions in ``sketches``; filter it first for a range of them."""
    return sketches.groupBy("column_name").agg(
        F.sum("present").alias("present"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )


def partition_states(
    spark: SparkSession, folder: str, partition: T.StructField, log2_registers: int = LOG2_REGISTERS
) -> DataFrame:
    """(partition_value, state): a number per partition that changes with names, sizes or times of its files.

    Files are listed, not opened. It changes with the size of sketches too, as sketches of two sizes are not merged.
    """
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
            partition,
        ]
    )
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.parquet").load(folder)
    mark = F.xxhash64("path", "length", "modificationTime", F.lit(log2_registers))
    return files.groupBy(F.col(f"`{partition.name}`").cast("string").alias("partition_value")).agg(F.bit_xor(mark).alias("state"))


def refresh_sketches(
    spark: SparkSession, root: str, schema: T.StructType, partition: str, store: str, log2_registers: int = LOG2_REGISTERS
) -> tuple[DataFrame, int]:
    """Bring the sketches at ``store`` up to date with the partitioned table at ``root``; returns them and how many partitions were read.

    Only partitions are read whose files are new or changed, or that lack a column; those that are gone leave. Which ones
    are due stands in a small written table, by which the scan is pruned when it runs. The sketches are published as a new
    version, so a reader always finds a complete profile. ``schema`` is the table's, its partition column included.
    """
    folder = published(spark, root)
    columns = [f.name for f in schema if f.name != partition]
    known = _stored(spark, store).where(F.col("column_name").isin(columns))
    whole = known.groupBy(F.col("partition_value").alias("_at"), F.col("state").alias("known")).agg(F.count("*").alias("n"))
    whole = whole.where(F.col("n") == len(columns))
    states = partition_states(spark, folder, schema[partition], log2_registers)
    same = F.col("partition_value").eqNullSafe(F.col("_at")) & (F.col("state") == F.col("known"))
    states = staged(states.join(whole, same, "left").select("partition_value", "state", F.expr("int(known IS NULL) AS due")), "states")
    due, done = (states.where(f"due = {k}").select(F.col("partition_value").alias("_at"), F.col("state").alias("now")) for k in (1, 0))
    table = spark.read.schema(schema).parquet(folder)
    days = due.select(F.col("_at").cast(schema[partition].dataType).alias("_at"))
    here = F.col(f"`{partition}`")
    # A scan is pruned by equal values when it runs; NULL has none, so its partition is a branch of its own.
    read = table.join(days.where("_at IS NOT NULL"), here == F.col("_at"), "left_semi")
    read = read.unionByName(table.where(here.isNull()).join(days.where("_at IS NULL"), here.eqNullSafe(F.col("_at")), "left_semi"))
    fresh = partition_sketches(read, partition, log2_registers).join(due, F.col("partition_value").eqNullSafe(F.col("_at")))
    kept = known.join(done, F.col("partition_value").eqNullSafe(F.col("_at")), "left_semi")
    fresh = fresh.select("partition_value", F.col("now").alias("state"), "column_name", "present", "sketch")
    out = publish(spark, store, lambda to: kept.unionByName(fresh).write.parquet(to))
    return spark.read.schema(STORED).parquet(out), due.count()


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """The sketches published at ``store``; none before the first refresh."""
    if published(spark, store) == store:
        return spark.createDataFrame([], STORED)
    return read_published(spark, store)
