"""Bikes: recent use, last place, idle time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c
from velomart.operators.windows import first_per_key


def latest_usage_date(usage: DataFrame) -> DataFrame:
    return usage.agg(F.expr("max(date_key) AS max_date"))


def active_bike_days(usage: DataFrame, after: str = "2023-01-01") -> DataFrame:
    """Bike-days with use after a day; on the partitioned table only later days are read."""
    return usage.where(f"date_key > DATE'{after}' AND daily_duration_minutes > 0").select("bike_id", "daily_duration_minutes")


def bike_last_location(hires: DataFrame, bikes: DataFrame) -> DataFrame:
    """Each bike's latest hire by end: where it went and when.

    The latest hire is picked before the bike rows are joined, so the join sees one row per
    bike. Ties: higher rental id, lower station id; of a bike's model rows the first by name.
    """
    latest = first_per_key(
        hires.select("bike_id", "end_station_id", "end_date", "rental_id"),
        ["bike_id"],
        [F.desc_nulls_last("end_date"), F.desc("rental_id"), F.asc("end_station_id")],
    )
    models = first_per_key(bikes, ["bike_id"], [F.asc("bike_model")])
    return latest.join(models, "bike_id").select(
        "bike_id",
        "bike_model",
        "total_duration_minutes",
        "end_station_id",
        F.col("end_date").alias("last_used"),
    )


def bike_idle_days(last_location: DataFrame, as_of: dt.date = dt.date(2023, 1, 31)) -> DataFrame:
    """Days since each bike's last use, with fraction; NULL for a bike never returned."""
    idle = c.micros_between("last_used", f"TIMESTAMP_NTZ'{as_of} 00:00:00'")
    return last_location.withColumn("idle_days", idle / float(c.MICROS_PER_DAY))
