"""Data checks; each returns the offending keys or rows, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velomart.sinks.tables import staged


def unique_offenders(df: DataFrame, column: str, fingerprint: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """Non-NULL values that occur more than once.

    Texts are counted by a 64-bit fingerprint first, which is what is shuffled; only rows whose fingerprint was seen
    twice are read again and compared as they are, so that two texts of one fingerprint are told apart.
    """
    rows = df.where(F.col(column).isNotNull()).select(column)
    if df.schema[column].dataType == T.StringType():
        mark = fingerprint(column).alias("fingerprint")
        twice = rows.groupBy(mark).agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
        # Written, so that its true size decides how rows are joined to it: mostly it is empty.
        rows = rows.withColumn("fingerprint", mark).join(staged(twice, "twice"), "fingerprint", "left_semi").select(column)
    return rows.groupBy(column).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


def null_offenders(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, failures) for several columns in one pass over the table."""
    wide = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return wide.unpivot([], columns, "column_name", "failures")


def orphan_offenders(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-NULL child keys without a parent row, with the number of child rows holding each.

    Child rows are counted per key first: the anti join compares keys, not rows.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("child_rows"))
    known = parent.select(F.col(parent_column).alias("parent_key"))
    return keys.join(known, F.col(column) == F.col("parent_key"), "left_anti")


def unaccepted_offenders(df: DataFrame, column: str, accepted: Iterable) -> DataFrame:
    """Values outside the accepted list, compared as text, with their row counts; NULL passes."""
    as_text = F.col(column).cast("string")
    return (
        df.where(~as_text.isin(*[str(value) for value in accepted]))
        .groupBy(column)
        .agg(F.count("*").alias("occurrences"))
    )


def orphan_keys(child: DataFrame, links: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(child_column, value, child_rows) of keys without a parent, for (column, parent, key) links of one child.

    One pass and one shuffle of the child, whatever the number of links; keys are compared as text.
    """
    columns = [column for column, *_ in links]
    keys = (
        child.select(*[F.col(name).cast("string").alias(name) for name in columns])
        .unpivot([], columns, "child_column", "value")
        .where("value IS NOT NULL")
        .groupBy("child_column", "value")
        .agg(F.count("*").alias("child_rows"))
    )
    known = reduce(
        DataFrame.unionAll,
        [
            parent.select(F.lit(column).alias("child_column"), F.col(key).cast("string").alias("value"))
            for column, parent, key in links
        ],
    )
    return keys.join(known, ["child_column", "value"], "left_anti").select("child_column", "value", "child_rows")
