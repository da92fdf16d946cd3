"""Staging: clean raw hires, fill in missing stations, derive the station list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c


def station_lookups(hires: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per side of a hire, the stations whose name occurs among the hires lacking an id there.

    One pass over the hires finds the names for both sides: a bit per side, or-ed per name, so
    both lookups filter the same aggregate and Spark runs its shuffle once. The IS NULL tests
    reach the Parquet scan. The names are semi-joined: the rows are those of an inner join, and
    the planner's size estimate stays that of ``stations``, so the hires get a lookup broadcast
    only if that table is under the broadcast threshold. Beyond it the hires are shuffled by
    name, and a hot name's partition is split at run time, which takes a shuffle right below
    both sides of that join. The redundant second key of the semi join sees to it: without it
    the lookup would be partitioned by name already and skip its shuffle.
    """
    names = (
        hires.where("start_station_id IS NULL OR end_station_id IS NULL")
        .selectExpr(
            """inline(array(
                 named_struct('name', start_station_name, 'side', if(start_station_id IS NULL, 1, 0)),
                 named_struct('name', end_station_name, 'side', if(end_station_id IS NULL, 2, 0))))"""
        )
        .groupBy("name")
        .agg(F.expr("bit_or(side) AS sides"))
        .selectExpr("name", "length(name) AS chars", "sides")
    )
    named = stations.selectExpr("id", "name", "length(name) AS chars")

    def lookup(side: str, bit: int) -> DataFrame:
        return (
            named.join(names.where(f"sides & {bit} <> 0"), ["name", "chars"], "left_semi")
            .selectExpr(f"id AS found_{side}_id", f"name AS found_{side}_name")
        )

    return lookup("start", 1), lookup("end", 2)


def stg_cycle_hire(
    hires: DataFrame, stations: DataFrame, lookups: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Hires that name a bike, with model and stations filled in.

    A station name held by several stations multiplies the hire; that is kept, and the
    uniqueness check on ``rental_id`` reports it. Where several tables are built from this
    view, pass ``lookups`` written once.
    """
    by_start, by_end = lookups or station_lookups(hires, stations)
    return (
        hires.where("bike_id IS NOT NULL")
        .join(by_start, F.expr("start_station_name = found_start_name"), "left")
        .join(by_end, F.expr("end_station_name = found_end_name"), "left")
        .select(
            "rental_id",
            "duration",
            "bike_id",
            c.staged_model().alias("bike_model"),
            "start_date",
            "end_date",
            c.start_station_id().alias("start_station_id"),
            # A lookup by name cannot supply a missing name, so names are passed through.
            "start_station_name",
            c.end_station_id().alias("end_station_id"),
            c.end_station_name().alias("end_station_name"),
        )
    )


def station_ends(hires: DataFrame) -> DataFrame:
    """Both ends of every hire as (station_id, station_name, starts, ends) in one pass."""
    return hires.selectExpr(
        """inline(array(
             named_struct('station_id', start_station_id, 'station_name', start_station_name, 'starts', 1, 'ends', 0),
             named_struct('station_id', end_station_id, 'station_name', end_station_name, 'starts', 0, 'ends', 1)))"""
    )


def locate(named: DataFrame, stations: DataFrame) -> DataFrame:
    """Add key and coordinates (0 if unknown) to (station_id, station_name) rows."""
    places = stations.selectExpr("id AS station_id", "latitude AS found_lat", "longitude AS found_lon")
    return (
        named.join(places, "station_id", "left")
        .select(
            *named.columns,
            c.surrogate_key("station_id", "station_name").alias("station_key"),
            F.expr("coalesce(found_lat, 0D) AS latitude"),
            F.expr("coalesce(found_lon, 0D) AS longitude"),
        )
    )


def stg_cycle_stations(stg_hires: DataFrame, stations: DataFrame) -> DataFrame:
    """Every (station id, name) seen at either end of a hire, with its place."""
    seen = station_ends(stg_hires).select("station_id", "station_name").distinct()
    return locate(seen.where("station_name IS NOT NULL"), stations).select(
        "station_key", "station_id", "station_name", "latitude", "longitude"
    )
