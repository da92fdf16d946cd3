"""Station flow, ranking and heat layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c


def station_net_inflow(hires: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations that lose bikes, by name: rides started, ended, and the (negative) difference.

    Hires are counted per station id, both ends in one pass, before names are joined, so the
    busiest station is one row in the join. Each name of an id gets that id's full counts.
    Grouping starts and ends together by name equals matching two grouped lists with a full
    outer join, but for hires whose station has no name: there the two lists do not match each
    other, so the starts stand alone (net below 0) and the ends are filtered out.
    """
    ends = hires.selectExpr(
        """inline(array(named_struct('station_id', start_station_id, 'starts', 1, 'ends', 0),
                        named_struct('station_id', end_station_id, 'starts', 0, 'ends', 1)))"""
    )
    per_id = ends.groupBy("station_id").agg(F.expr("sum(starts) AS starts"), F.expr("sum(ends) AS ends"))
    per_name = (
        per_id.join(stations.select("station_id", "station_name"), "station_id", "left")
        .groupBy("station_name")
        .agg(F.expr("sum(starts) AS rides_started"), F.expr("sum(ends) AS ends"))
    )
    return (
        per_name.selectExpr(
            "station_name", "rides_started", "if(station_name IS NULL, 0L, ends) AS rides_ended"
        )
        .selectExpr("*", "rides_ended - rides_started AS net_inflow")
        .where("net_inflow < 0")
        .orderBy("net_inflow", "station_name")
    )


def top_net_outflow(hires: DataFrame, stations: DataFrame, n: int = 10) -> DataFrame:
    return station_net_inflow(hires, stations).limit(n)


def top_start_stations(hires: DataFrame, stations: DataFrame, n: int = 10) -> DataFrame:
    """The names most rides start from; an id's rides count for each of its names."""
    per_id = hires.groupBy("start_station_id").agg(F.expr("count(*) AS rides"))
    return (
        per_id.join(stations, F.expr("start_station_id = station_id"))
        .groupBy("station_name")
        .agg(F.expr("sum(rides) AS total_rides"))
        .orderBy(F.desc("total_rides"), "station_name")
        .limit(n)
    )


def station_heat_matches(raw_stations: DataFrame, stations: DataFrame) -> DataFrame:
    """Raw stations with the traffic found under (id, name) and under (terminal, name)."""
    matched = raw_stations
    for key, found in (("id", "weight_by_id"), ("terminal_name", "weight_by_terminal")):
        traffic = stations.selectExpr(
            "station_id AS match_id",
            "station_name AS match_name",
            f"total_start_count + total_end_count AS {found}",
        )
        same = F.expr(f"cast({key} AS bigint) = match_id AND name = match_name")
        matched = matched.join(traffic, same, "left").drop("match_id", "match_name")
    return matched


def station_heat_unmatched(raw_stations: DataFrame, stations: DataFrame) -> DataFrame:
    """Raw stations without traffic under either key."""
    matches = station_heat_matches(raw_stations, stations)
    return matches.where(
        "weight_by_id IS NULL AND weight_by_terminal IS NULL"
    ).select("id", "name", "terminal_name")


def station_heat(raw_stations: DataFrame, stations: DataFrame) -> DataFrame:
    """(latitude, longitude, weight) per raw station, 0 without traffic."""
    return station_heat_matches(raw_stations, stations).select(
        "latitude",
        "longitude",
        c.zero_if_missing("weight_by_id", "weight_by_terminal").alias("magnitude"),
    )


def heat_has_missing(heat: DataFrame) -> DataFrame:
    """Whether any heat row lacks a value, per column."""
    return heat.agg(
        *[F.expr(f"coalesce(max({x} IS NULL), false) AS {x}_missing") for x in heat.columns]
    )


def station_arrivals(hires: DataFrame, station: int) -> DataFrame:
    """(start_date_key, arrivals, bikes): hires that ended at a station, by the day they began.

    Reads few row groups of a table that is clustered by all its ids alike.
    """
    return (
        hires.where(F.col("end_station_id") == station)
        .groupBy("start_date_key")
        .agg(F.count("*").alias("arrivals"), F.count_distinct("bike_id").alias("bikes"))
    )
