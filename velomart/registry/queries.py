"""Every query by name: ``(spark, sf_dir) -> DataFrame``.

Models are composed lazily from the test tables. Results that a query reads more than once are staged
(written and read back), which runs jobs when the query is built; checks, profiles and copies run on built tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.operators import aggregates, profiles, quality, sorting
from velomart.plans import (
    altstar, calendar, checks, demand, fleet, lifecycle, staging, star, stations, trend, warehouse,
)
from velomart.sinks.tables import copy_tables, ensure_database, replace_table, run_key, staged, work_folder, write_partitioned
from velomart.sources import bridge, catalog
from velomart.sources.registry import Source, SourceRegistry
from velomart.sources.scans import ingest_report, scan_date_seed, scan_parquet, scan_stations_csv, shard_differences, unreadable_stations


_BUILT: dict[tuple, dict[str, DataFrame]] = {}


class Models:
    """The warehouse models over one pair of raw tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, hires: DataFrame, raw_stations: DataFrame, origin: str):
        self.spark = spark
        self.hires = hires
        self.raw_stations = raw_stations
        self.origin = origin

    @cached_property
    def stg_hires(self):
        return staging.stg_cycle_hire(self.hires, self.raw_stations)

    @cached_property
    def stg_stations(self):
        return staging.stg_cycle_stations(self.stg_hires, self.raw_stations)

    @cached_property
    def dim_bike(self):
        return star.dim_bike(self.stg_hires)

    @cached_property
    def dim_station(self):
        return star.dim_station(self.stg_hires, self.raw_stations)

    @cached_property
    def dim_date(self):
        return calendar.dim_date_spanning(self.hires)

    @cached_property
    def fact_hire(self):
        return star.fact_hire(self.stg_hires)

    @cached_property
    def daily_usage(self):
        return star.fact_bike_daily_usage(self.fact_hire, self.dim_bike, self.dim_date)

    @cached_property
    def usage_table(self):
        """The daily usage as written, partitioned by day."""
        built = warehouse.Warehouse(self.spark, work_folder(self.spark))
        return built.save_usage(
            staged(self.fact_hire, "fact_hire"), staged(self.dim_bike, "dim_bike"), staged(self.dim_date, "dim_date")
        )

    @property
    def built(self):
        """Both stars as written tables, by name; built once for all queries of the session on the same raw tables."""
        key = (*run_key(self.spark), self.origin)
        if key not in _BUILT:
            folder = warehouse.Warehouse(self.spark, work_folder(self.spark))
            tables = warehouse.build_star(folder, self.hires, self.raw_stations)
            _BUILT[key] = tables | warehouse.build_alternative(folder, self.hires)
        return _BUILT[key]

    @cached_property
    def alt_dim_station(self):
        """Staged: the hires join it twice, and written its size is known to the planner."""
        return staged(altstar.dim_station(self.hires), "alt_dim_station")

    @cached_property
    def alt_fact_hires(self):
        return altstar.fact_hires(self.hires, self.alt_dim_station)

    @cached_property
    def month_trend(self):
        return staged(trend.trend_month_model(self.fact_hire, self.dim_bike), "trend")

    @cached_property
    def durations(self):
        """Over the staged spans, so the hires are read once."""
        return lifecycle.bike_durations(staged(lifecycle.hire_spans(self.fact_hire), "spans"))

    @cached_property
    def rentals(self):
        return demand.rentals_by_calendar(self.fact_hire, self.dim_date)


def short_hires(spark: SparkSession, sf_dir: str) -> Models:
    """A month of hires with hours, gaps and open hires."""
    return Models(
        spark, bridge.hires_from_events(spark, sf_dir), bridge.stations_from_suppliers(spark, sf_dir), f"events {sf_dir}"
    )


def long_hires(spark: SparkSession, sf_dir: str) -> Models:
    """Hires over several years."""
    return Models(
        spark, bridge.hires_from_orders(spark, sf_dir), bridge.stations_from_suppliers(spark, sf_dir), f"orders {sf_dir}"
    )


def _profile(m: Models) -> DataFrame:
    """Distinct counts over the built star."""
    return aggregates.table_profile({name: m.built[name] for name in warehouse.STAR_TABLES})


def _merged_profile(m: Models) -> DataFrame:
    """Hires of the later days are added to a sketched table; the merged profile is held against the exact counts."""
    hires, day = m.built["fact_hire"], F.col("start_date_key")
    folder, later = work_folder(m.spark), day >= F.lit("2023-01-20").cast("date")
    write_partitioned(hires.where(~later), f"{folder}/hires", "start_date_key", ["bike_id"])
    where = (m.spark, f"{folder}/hires", hires.schema, "start_date_key", f"{folder}/profile")
    profiles.refresh_sketches(*where)
    hires.where(later).write.mode("append").partitionBy("start_date_key").parquet(f"{folder}/hires")
    sketches, days_read = profiles.refresh_sketches(*where)
    exact = aggregates.distinct_counts(hires.drop("start_date_key"))
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    return (
        profiles.merged_profile(sketches)
        .join(exact, "column_name")
        .withColumn("within_bound", off <= F.col("distinct_count") * profiles.error_bound())
        .withColumn("days_read", F.lit(days_read).cast("long"))
        .drop("distinct_estimate")
    )


def _database_profile(m: Models) -> DataFrame:
    """Profile of a database by the catalog: its star tables are counted, its staging table is passed over."""
    database = f"velomart_{uuid.uuid4().hex}"
    ensure_database(m.spark, database)
    try:
        tables = {"dim_bike": m.built["dim_bike"], "dim_station": m.built["dim_station"], "stg_cycle_stations": m.stg_stations}
        for name, df in tables.items():
            replace_table(df, f"`{database}`.`{name}`")
        return staged(catalog.profile_database(m.spark, database), "profile")
    finally:
        m.spark.sql(f"DROP DATABASE `{database}` CASCADE")


def _unique_report(m: Models) -> DataFrame:
    """Repeated values of every column declared unique."""
    parts = [
        quality.unique_offenders(m.built[table], name).select(
            F.lit(f"{table}.{name}").alias("checked"), F.col(name).cast("string").alias("value"), "occurrences"
        )
        for table, names in {**checks.UNIQUE, **checks.EXTRA_UNIQUE}.items()
        for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def _relationship_report(m: Models) -> DataFrame:
    """Values of every declared foreign key that lack their parent."""
    parts = [
        quality.orphan_keys(m.built[child], checks.links_of(m.built, child)).withColumn("child_table", F.lit(child))
        for child in dict.fromkeys(child for child, *_ in checks.RELATIONSHIPS)
    ]
    return reduce(DataFrame.unionByName, parts)


def _null_report(m: Models) -> DataFrame:
    """Declared columns that have NULLs all the same."""
    parts = [
        quality.null_counts(m.built[table], names).withColumn("table_name", F.lit(table))
        for table, names in checks.NOT_NULL.items()
    ]
    return reduce(DataFrame.unionByName, parts).where("failures > 0")


def _accepted_report(m: Models) -> DataFrame:
    """Rows seen and rows outside the list, for every column with accepted values."""
    parts = []
    for table, name, accepted in checks.ACCEPTED:
        outside = quality.unaccepted_offenders(m.built[table], name, accepted).agg(F.sum("occurrences"))
        parts.append(
            m.built[table]
            .agg(F.count(name).alias("checked_rows"))
            .select(F.lit(name).alias("column_name"), "checked_rows", F.coalesce(outside.scalar(), F.lit(0)).alias("failures"))
        )
    return reduce(DataFrame.unionByName, parts)


def _check_report(m: Models) -> DataFrame:
    """Every declared check on the built tables."""
    return checks.check_report(m.built)


def _partitioned_days(m: Models) -> DataFrame:
    """Write the hire fact by day, read it back and query the days after the first week."""
    built = warehouse.Warehouse(m.spark, work_folder(m.spark))
    hires = built.save("fact_hire", m.fact_hire)
    return (
        hires.where(F.col("start_date_key") > F.lit("2023-01-07").cast("date"))
        .groupBy("start_date_key")
        .agg(F.count("*").alias("rides"), F.sum("duration_minutes").alias("minutes"))
    )


def _copy_report(m: Models) -> DataFrame:
    """Copy the star tables and one that nothing builds."""
    names = [*warehouse.STAR_TABLES, "next_gen_station_table"]
    return copy_tables(m.spark, names, m.built, work_folder(m.spark)).drop("error")


def _rebuild_report(m: Models) -> DataFrame:
    """Build the star twice into one folder and database; the second build replaces every table, read by its name."""
    database = f"velomart_{uuid.uuid4().hex}"
    built = warehouse.Warehouse(m.spark, work_folder(m.spark), database)
    try:
        warehouse.build_star(built, m.hires, m.raw_stations)
        warehouse.build_star(built, m.hires, m.raw_stations)
        rows = [(name, built.read(name).count()) for name in warehouse.STAR_TABLES]
    finally:
        m.spark.sql(f"DROP DATABASE `{database}` CASCADE")
    return m.spark.createDataFrame(rows, "table_name string, row_count long")


def _station_arrivals(m: Models) -> DataFrame:
    """Arrivals at one station, from the hires clustered by bike, start and end alike."""
    built = warehouse.Warehouse(m.spark, work_folder(m.spark))
    return stations.station_arrivals(built.save_curve("fact_hire", staged(m.fact_hire, "fact_hire")), 7)


def _weekend_rides(m: Models) -> DataFrame:
    """Rides of the weekends of the first quarter, from the hires partitioned by day."""
    built = warehouse.Warehouse(m.spark, work_folder(m.spark))
    hires, dates = built.save("fact_hire", m.fact_hire), built.save("dim_date", m.dim_date.coalesce(1))
    return demand.rides_on_days(hires, dates, "quarter = '1' AND day_type = 'Weekend'")


def _csv_stations(m: Models) -> str:
    """The raw stations as CSV with one more column; every eleventh id is not a number, and some lines lack fields or have too many."""
    path = work_folder(m.spark)
    header = ["terminal_name", "kind", "id", "name", "latitude", "longitude"]
    m.raw_stations.selectExpr(
        "terminal_name", "'docked' AS kind", "if(id % 11 = 0, concat('x', id), string(id)) AS id", "name", "latitude", "longitude"
    ).write.option("header", True).csv(f"{path}/whole")
    line = "if(id % 13 = 0, concat(terminal_name, ',short'), concat(terminal_name, ',long,', id, ',', name, ',51.5,-0.1,more'))"
    # One column whose name is the header line; nothing is quoted, as no value holds the separator.
    lines = m.raw_stations.where("id % 13 = 0 OR id % 17 = 0").selectExpr(f"{line} AS `{','.join(header)}`")
    lines.write.options(header=True, sep="\u0001").csv(f"{path}/broken")
    return f"{path}/*"


def _csv_kinds(m: Models) -> DataFrame:
    """Stations by the CSV's further column, and how many of them have an id."""
    stations_read = scan_stations_csv(m.spark, _csv_stations(m))
    return stations_read.groupBy("kind").agg(F.count("*").alias("stations"), F.count("id").alias("with_id"))


def _csv_heat(m: Models) -> DataFrame:
    """The heat layer from stations read as CSV."""
    path = work_folder(m.spark)
    m.raw_stations.write.option("header", True).csv(path)
    return stations.station_heat(scan_stations_csv(m.spark, path), m.dim_station)


def _date_seed(m: Models) -> DataFrame:
    """The calendar of the hires through a CSV seed."""
    path = work_folder(m.spark)
    m.dim_date.write.option("header", True).csv(path)
    return scan_date_seed(m.spark, path)


def _catalog_report(m: Models) -> DataFrame:
    """Save tables into a database of their own, list and load them by frame name, and count."""
    database = f"velomart_{uuid.uuid4().hex}"
    ensure_database(m.spark, database)
    try:
        for name, df in (("dim_bike", m.dim_bike), ("dim_station", m.dim_station), ("stg_cycle_hire", m.stg_hires)):
            replace_table(df.limit(1), f"`{database}`.`{name}`")
            replace_table(df, f"`{database}`.`{name}`")
        listed = [(base, name) for base, name in catalog.list_tables(m.spark) if base == database]
        frames = catalog.load_frames(m.spark, listed)
        rows = [
            (name.removeprefix(f"{database}_"), len(catalog.list_columns(m.spark, f"{base}.{table}")), catalog.describe(frames[name])["shape"][0])
            for base, table in listed
            for name in [catalog.frame_name(table, base)]
        ]
    finally:
        m.spark.sql(f"DROP DATABASE `{database}` CASCADE")
    return m.spark.createDataFrame(rows, "frame_name string, columns int, row_count long")


def _zoned_times(m: Models) -> DataFrame:
    """Hires whose times were written with a zone, read through a declared source, by hour in UTC."""
    path = f"{work_folder(m.spark)}/zoned"
    m.hires.withColumn("start_date", F.expr("cast(concat(start_date, '+00:00') AS timestamp)")).write.parquet(path)
    declared = SourceRegistry("lake", {"cycle_hire": {"lake": Source(path=f"{path}*"), "catalog": Source(table="cycle_hire")}})
    hires = declared.read(m.spark, "cycle_hire")
    return hires.groupBy(F.hour("start_date").alias("start_hour")).agg(F.count("*").alias("hires"))


def _export_shards(m: Models, lake: str) -> None:
    """The raw tables as exports leave them: two shards of hires, the earlier with narrower ids and without two columns."""
    early = m.hires.where("rental_id % 2 = 0").drop("bike_model", "end_station_priority_id")
    early.withColumns({name: F.col(name).cast("int") for name in ("rental_id", "duration")}).write.parquet(f"{lake}/export_cycle_hire_2022")
    m.hires.where("rental_id % 2 = 1").write.parquet(f"{lake}/export_cycle_hire_2023")
    m.raw_stations.write.parquet(f"{lake}/export_cycle_stations_shards")


def _ingest_report(m: Models) -> DataFrame:
    """Export the raw tables as shards, then ingest them by wildcard."""
    lake, raw = work_folder(m.spark), work_folder(m.spark)
    _export_shards(m, lake)
    return ingest_report(
        m.spark,
        {
            "cycle_hire": (f"{lake}/*cycle_hire*", f"{raw}/cycle_hire"),
            "cycle_stations": (f"{lake}/*cycle_station*", f"{raw}/cycle_stations"),
        },
    )


def _shard_report(m: Models) -> DataFrame:
    """Columns in which the shards of the hires differ, with the values that reach the reconciled scan."""
    lake = work_folder(m.spark)
    _export_shards(m, lake)
    pattern = f"{lake}/*cycle_hire*"
    found = shard_differences(m.spark, pattern)
    values = aggregates.value_counts(scan_parquet(m.spark, pattern))
    return found.join(values, "column_name")


def _lifecycle_section(section: str) -> Callable[[Models], DataFrame]:
    return lambda m: lifecycle.lifecycle_section(lifecycle.lifecycle_combined(m.durations), section)


SHORT: dict[str, Callable[[Models], DataFrame]] = {
    # staging and star
    "stg_cycle_hire": lambda m: m.stg_hires,
    "stg_cycle_stations": lambda m: m.stg_stations,
    "dim_bike": lambda m: m.dim_bike,
    "dim_station": lambda m: m.dim_station,
    "fact_hire": lambda m: m.fact_hire,
    "fact_bike_daily_usage": lambda m: m.daily_usage,
    # alternative star
    "alt_dim_station": lambda m: altstar.dim_station(m.hires),
    "alt_fact_hires": lambda m: m.alt_fact_hires,
    "alt_fact_hires_listed": lambda m: altstar.fact_hires_listed(m.hires, m.alt_dim_station),
    "dim_duration_by_month": lambda m: altstar.dim_duration_by_month(m.alt_fact_hires),
    # demand
    "rides_by_weekday": lambda m: demand.rides_by_weekday(m.fact_hire, m.dim_date),
    "rides_by_hour": lambda m: demand.rides_by_hour(m.fact_hire),
    "rides_by_hour_ts": lambda m: demand.rides_by_hour_ts(m.fact_hire),
    "weekend_rides": _weekend_rides,
    "station_arrivals": _station_arrivals,
    "peak_offpeak": lambda m: demand.peak_offpeak(m.fact_hire),
    "minute_profile": lambda m: demand.minute_profile(m.fact_hire),
    "minute_profile_labelled": lambda m: demand.minute_profile_labelled(demand.minute_profile(m.fact_hire)),
    "time_of_day_mean": lambda m: demand.time_of_day_mean(demand.minute_profile(m.fact_hire)),
    # stations
    "station_net_inflow": lambda m: stations.station_net_inflow(m.fact_hire, m.dim_station),
    "top_net_outflow": lambda m: stations.top_net_outflow(m.fact_hire, m.dim_station),
    "top_start_stations": lambda m: stations.top_start_stations(m.fact_hire, m.dim_station),
    "station_heat": lambda m: stations.station_heat(m.raw_stations, m.dim_station),
    "station_heat_unmatched": lambda m: stations.station_heat_unmatched(m.raw_stations, m.dim_station),
    "station_heat_has_missing": lambda m: stations.heat_has_missing(
        stations.station_heat(m.raw_stations, m.dim_station)
    ),
    # fleet
    "latest_usage_date": lambda m: fleet.latest_usage_date(m.usage_table),
    "active_bike_days": lambda m: fleet.active_bike_days(m.usage_table),
    "bike_last_location": lambda m: fleet.bike_last_location(m.fact_hire, m.dim_bike),
    "bike_idle_days": lambda m: fleet.bike_idle_days(fleet.bike_last_location(m.fact_hire, m.dim_bike)),
    # checks and profiles
    "profile_distinct": _profile,
    "profile_merged": _merged_profile,
    "profile_database": _database_profile,
    "dq_unique": _unique_report,
    "dq_not_null": _null_report,
    "dq_relationships": _relationship_report,
    "dq_accepted_values": _accepted_report,
    "dq_report": _check_report,
    # sources and sinks
    "raw_ingest_status": _ingest_report,
    "raw_shard_differences": _shard_report,
    "partitioned_fact_hire": _partitioned_days,
    "table_copy_status": _copy_report,
    "rebuild_status": _rebuild_report,
    "stations_csv_kinds": _csv_kinds,
    "stations_csv_unreadable": lambda m: unreadable_stations(m.spark, _csv_stations(m)),
    "stations_csv_heat": _csv_heat,
    "catalog_frames": _catalog_report,
    "zoned_start_hours": _zoned_times,
}

LONG: dict[str, Callable[[Models], DataFrame]] = {
    "dim_date": lambda m: m.dim_date,
    "date_seed": _date_seed,
    "uncovered_days": lambda m: calendar.uncovered_days(m.fact_hire, calendar.dim_date(m.spark)),
    "trend_month_model": lambda m: trend.trend_month_model(m.fact_hire, m.dim_bike).orderBy("year_month", "bike_model"),
    "trend_pivot": lambda m: trend.trend_pivot(m.month_trend),
    "trend_modern_era": lambda m: trend.trend_modern_era(m.month_trend),
    "trend_share": lambda m: trend.trend_share(m.month_trend),
    "trend_share_pivot": lambda m: trend.trend_share_pivot(m.month_trend),
    "lifecycle_detail": lambda m: lifecycle.lifecycle_detail(m.durations),
    "lifecycle_summary": lambda m: lifecycle.lifecycle_summary(m.durations),
    "lifecycle_histogram": lambda m: lifecycle.lifecycle_histogram(m.durations),
    "lifecycle_combined": lambda m: lifecycle.lifecycle_combined(m.durations),
    "lifecycle_section_detail": _lifecycle_section("detail"),
    "lifecycle_section_summary": _lifecycle_section("summary"),
    "lifecycle_section_histogram": _lifecycle_section("histogram"),
    "rentals_by_calendar": lambda m: m.rentals,
    "monthly_series_tail": lambda m: sorting.tail(demand.monthly_series(m.rentals), "month_start", 5),
    "monthly_series": lambda m: demand.monthly_series(m.rentals),
    "weekday_winter_series": lambda m: demand.weekday_winter_series(m.rentals),
    "weekday_winter_mean": lambda m: demand.weekday_winter_mean(m.rentals),
}


def _bind(build: Callable[[Models], DataFrame], raw: Callable[[SparkSession, str], Models]):
    return lambda spark, sf_dir: build(raw(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = {name: _bind(build, short_hires) for name, build in SHORT.items()}
    bound |= {name: _bind(build, long_hires) for name, build in LONG.items()}
    return bound
