"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_median(df: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """The two middle values (equal for an odd count) of an integer column per group: (group, low, high), exact.

    The built-in exact median keeps a group's values in one task's memory, and with few groups that is most of the
    data. Here one pass builds a mergeable quantile sketch per group, whose error in rank is bounded by one in ``accuracy``,
    and takes two values that must enclose the middle; a second pass counts what lies below them and, value by value, what
    lies between, some thousandths of the rows. Both are partially aggregated; what is joined to the rows is
    one bracket per group, and the window runs over the counted values between. Reads ``df`` twice; NULL values are left out, and a group
    without others has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    margin = 3 / accuracy
    # Below some thousand values the rounding of the two shares to ranks matters; the whole range is no more then.
    enclosing = F.percentile_approx("v", F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(accuracy))
    small = F.count("*") <= 10 * accuracy
    brackets = rows.groupBy("g").agg(
        F.count("*").alias("total"),
        F.when(small, F.min("v")).otherwise(enclosing[0]).alias("least"),
        F.when(small, F.max("v")).otherwise(enclosing[1]).alias("most"),
    )
    counted = (
        rows.join(brackets, "g")
        .where("v <= most")
        .groupBy("g", "total", F.expr("if(v < least, NULL, v) AS v"))
        .agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))

    def holds(rank: str) -> str:
        return f"before <= {rank} AND {rank} < upto"

    found = placed.groupBy("g").agg(
        F.expr(f"max(if({holds('(total - 1) div 2')}, v, NULL)) AS low"), F.expr(f"max(if({holds('total div 2')}, v, NULL)) AS high")
    )
    return found.withColumnRenamed("g", group)


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, present): how many rows have a value in each column; one aggregate over one pass."""
    counted = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    return counted.unpivot([], [F.col(f"`{name}`") for name in df.columns], "column_name", "present")


def as_text(df: DataFrame, name: str) -> Column:
    """A column's values as texts, equal where the values are: 0.0 and -0.0 have one text."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        value = value + F.lit(0).cast(df.schema[name].dataType)
    return value.cast("string")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_count) for every column, exact, NULLs not counted.

    One pass: the columns become (name, value as text) rows, which are made distinct before and after
    one shuffle. See ``profiles`` for estimates merged from sketches, which shuffle no values.
    """
    names = df.columns
    distinct = (
        df.select(*[as_text(df, name).alias(name) for name in names])
        .unpivot([], [F.col(f"`{name}`") for name in names], "column_name", "value")
        .where("value IS NOT NULL")
        .distinct()
    )
    counted = distinct.groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    listed = df.sparkSession.createDataFrame([(name,) for name in names], "column_name string")
    return listed.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count")
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``distinct_counts`` of several tables, labelled by table."""
    parts = [
        distinct_counts(df).select(F.lit(name).alias("table_name"), "column_name", "distinct_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
