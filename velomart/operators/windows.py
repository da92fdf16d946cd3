"""Window-based operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given (total) order.

    Filtering row_number to 1 lets Spark keep only the best row per key in each map task
    before the shuffle, so a key with a large share of the rows sends one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(ranked)).where(F.col("_nth") == 1).drop("_nth")
