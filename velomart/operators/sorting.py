"""Peeks at an ordered result; Spark keeps the n best rows per task and merges those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The first n rows by a column."""
    return df.orderBy(F.asc(by)).limit(n)


def tail(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The last n rows by a column, in ascending order."""
    return df.orderBy(F.desc(by)).limit(n).orderBy(F.asc(by))
