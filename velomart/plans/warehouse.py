"""Build the whole warehouse: every model in dependency order, each table replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velomart.operators.profiles import merged_profile, refresh_sketches
from velomart.plans import altstar, calendar, staging, star
from velomart.sinks.tables import ensure_database, point_table, publish, read_published, staged, write_curve, write_days, write_partitioned

# Partition column and clustering of the partitioned tables.
PARTITIONED = {
    "fact_hire": ("start_date_key", ["bike_id", "start_station_id", "end_station_id"]),
    "fact_bike_daily_usage": ("date_key", ["bike_id"]),
}
STAR_TABLES = ["dim_bike", "dim_station", "dim_date", "fact_bike_daily_usage", "fact_hire"]


class Warehouse:
    """Tables under one folder; ``save`` replaces a table and returns it as written.

    The facts are partitioned by day. Every build of a table has a folder of its own and is published when complete, so
    readers find the old rows or the new ones at every moment. With a ``database`` each table is known to the catalog too,
    by one statement per build.
    """

    def __init__(self, spark: SparkSession, folder: str, database: str | None = None):
        self.spark = spark
        self.folder = folder
        self.database = database
        if database:
            ensure_database(spark, database)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{name}`") if self.database else read_published(self.spark, self.path(name))

    def _publish(self, name: str, df: DataFrame, write: Callable[[str], None]) -> DataFrame:
        """``df`` as written: read from its version, which the next build leaves in place."""
        partition = PARTITIONED.get(name, (None,))[0]

        def point(folder: str) -> None:
            point_table(self.spark, f"`{self.database}`.`{name}`", df.schema, folder, partition)

        folder = publish(self.spark, self.path(name), write, point if self.database else None)
        return self.spark.read.schema(df.schema).parquet(folder).select(*df.columns)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        if name in PARTITIONED:
            return self._publish(name, df, lambda folder: write_partitioned(df, folder, *PARTITIONED[name]))
        return self._publish(name, df, lambda folder: df.write.parquet(folder))

    def save_curve(self, name: str, df: DataFrame) -> DataFrame:
        """Save a partitioned table clustered by all of its columns alike; ``df`` is read several times, a written table best."""
        return self._publish(name, df, lambda folder: write_curve(df, folder, *PARTITIONED[name]))

    def save_usage(self, hires: DataFrame, bikes: DataFrame, dates: DataFrame) -> DataFrame:
        """Build and save the daily usage; its rows are brought together by month before they are days."""
        name = "fact_bike_daily_usage"
        df = star.usage_days(star.usage_by_month(star.usage_runs(hires, bikes, dates)), dates)
        return self._publish(name, df, lambda folder: write_days(df, folder, *PARTITIONED[name]))

    def profile(self, name: str) -> DataFrame:
        """(column_name, present, distinct_estimate) of a partitioned table, merged from sketches kept beside it.

        Days whose files have not changed since the last call are not read; a table built anew is read whole.
        """
        schema, partition = self.read(name).schema, PARTITIONED[name][0]
        sketches, _ = refresh_sketches(self.spark, self.path(name), schema, partition, f"{self.path(name)}__profile")
        return merged_profile(sketches)


def build_star(warehouse: Warehouse, hires: DataFrame, stations: DataFrame, dates: DataFrame | None = None):
    """Build the star tables from raw data; returns them by name, read from the written files.

    Staging stays a view over the raw scan: reading the raw columns a table needs again is
    cheaper than writing all of them. Its two station lookups are written once. ``dates``: a loaded seed;
    without one the calendar spans the days of the hires, so that none drops out.
    """
    by_start, by_end = staging.station_lookups(hires, stations)
    lookups = staged(by_start, "start_lookup"), staged(by_end, "end_lookup")
    staged_hires = staging.stg_cycle_hire(hires, stations, lookups)
    tables = {}
    tables["dim_date"] = warehouse.save(
        "dim_date", (calendar.dim_date_spanning(hires) if dates is None else dates).coalesce(1)
    )
    tables["dim_bike"] = warehouse.save("dim_bike", star.dim_bike(staged_hires))
    tables["dim_station"] = warehouse.save("dim_station", star.dim_station(staged_hires, stations))
    tables["fact_hire"] = warehouse.save("fact_hire", star.fact_hire(staged_hires))
    tables["fact_bike_daily_usage"] = warehouse.save_usage(
        tables["fact_hire"], tables["dim_bike"], tables["dim_date"]
    )
    return tables


def build_alternative(warehouse: Warehouse, hires: DataFrame):
    """Build the alternative star. Its station list is written before the fact is joined to it,
    so the planner knows its size."""
    tables = {}
    tables["alt_dim_station"] = warehouse.save("alt_dim_station", altstar.dim_station(hires))
    tables["alt_fact_hires"] = warehouse.save(
        "alt_fact_hires", altstar.fact_hires(hires, tables["alt_dim_station"])
    )
    tables["dim_duration_by_month"] = warehouse.save(
        "dim_duration_by_month", altstar.dim_duration_by_month(tables["alt_fact_hires"])
    )
    return tables
