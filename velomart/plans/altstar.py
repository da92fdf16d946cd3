"""The alternative star: surrogate station keys on the hire fact, durations by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c
from velomart.plans.staging import station_ends


def dim_station(hires: DataFrame) -> DataFrame:
    """Every (id, name) at either end of a raw hire, NULLs included."""
    seen = station_ends(hires).select("station_id", "station_name").distinct()
    return seen.select(
        c.surrogate_key("station_id", "station_name").alias("station_key"), "station_id", "station_name"
    )


def _with_station_key(hires: DataFrame, stations: DataFrame, side: str) -> DataFrame:
    """Inner join on id and name with NULL read as 0 and '', so NULL and default match."""
    keys = stations.selectExpr(
        "coalesce(station_id, 0L) AS match_id",
        "coalesce(station_name, '') AS match_name",
        f"station_key AS {side}_station_key",
    )
    same = (
        f"coalesce({side}_station_id, 0L) = match_id AND coalesce({side}_station_name, '') = match_name"
    )
    return hires.join(keys, F.expr(same)).drop("match_id", "match_name")


def fact_hires(hires: DataFrame, stations: DataFrame) -> DataFrame:
    """Raw hires with the four station columns replaced by two station keys."""
    keyed = _with_station_key(_with_station_key(hires, stations, "start"), stations, "end")
    return keyed.drop(
        "start_station_id", "start_station_name", "end_station_id", "end_station_name"
    )


def fact_hires_listed(hires: DataFrame, stations: DataFrame) -> DataFrame:
    """The same fact with its columns named one by one."""
    return fact_hires(hires, stations).select(
        "rental_id",
        "duration",
        "duration_ms",
        "bike_id",
        "bike_model",
        "start_date",
        "end_date",
        "start_station_key",
        "end_station_key",
        "start_station_logical_terminal",
        "end_station_logical_terminal",
        "end_station_priority_id",
    )


def dim_duration_by_month(facts: DataFrame) -> DataFrame:
    """Seconds and rentals per month of the end date and model; open hires form a NULL month."""
    return (
        facts.groupBy(
            c.month_start("end_date").alias("rental_month"),
            c.month_label("end_date").alias("month_label"),
            c.reported_model().alias("bike_model"),
        )
        .agg(
            F.expr("sum(duration) AS total_duration_seconds"),
            F.expr("count(rental_id) AS total_rentals"),
        )
        .orderBy(F.desc("rental_month"), "bike_model")
    )
