"""The date dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.functions import columns as c

# The days taken for the date seed, whose file is not given.
FIRST_DAY = dt.date(2015, 1, 1)
LAST_DAY = dt.date(2023, 1, 31)

DIM_DATE_SCHEMA = (
    "date_key DATE, year STRING, month STRING, quarter STRING, day_of_week STRING, day_type STRING"
)


def _dim_date_columns(days: DataFrame) -> DataFrame:
    return days.select(
        "date_key",
        c.expr("string(year(date_key)) AS year"),
        c.expr("string(month(date_key)) AS month"),
        c.expr("string(quarter(date_key)) AS quarter"),
        c.iso_dow("date_key").cast("string").alias("day_of_week"),
        c.expr(
            f"""CASE WHEN date_key = {c.open_end_day()} THEN 'Unknown'
                     WHEN weekday(date_key) >= 5 THEN 'Weekend' ELSE 'Weekday' END AS day_type"""
        ),
    )


def dim_date(spark: SparkSession, first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY) -> DataFrame:
    """One row per day from ``first`` to ``last`` and one for the open-end day."""
    days = f"concat(sequence(DATE'{first}', DATE'{last}'), array({c.open_end_day()}))"
    return _dim_date_columns(spark.range(1).selectExpr(f"explode({days}) AS date_key"))


def dim_date_spanning(hires: DataFrame) -> DataFrame:
    """The date dimension over the days the hires cover, first start to last start or end."""
    span = hires.agg(
        c.expr("date(min(start_date)) AS first"),
        c.expr("date(greatest(max(start_date), max(end_date))) AS last"),
    )
    days = f"concat(sequence(first, last), array({c.open_end_day()}))"
    return _dim_date_columns(span.selectExpr(f"explode({days}) AS date_key"))


def uncovered_days(hires: DataFrame, dates: DataFrame) -> DataFrame:
    """(start_date_key, hires): start days that a calendar lacks; their hires drop out of what is joined to it."""
    counted = hires.groupBy("start_date_key").agg(F.count("*").alias("hires"))
    return counted.join(dates.select("date_key"), F.col("start_date_key") == F.col("date_key"), "left_anti")
