"""The declared checks on the warehouse tables and their run as one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.operators import quality

# Which column of which table each check is declared on.
NOT_NULL = {
    "fact_hire": [
        "rental_id", "duration_minutes", "start_date", "start_hour", "bike_id",
        "start_station_id", "start_date_key", "end_date_key",
    ],
    "dim_bike": ["bike_id", "bike_model", "total_duration_minutes"],
    "dim_station": [
        "station_key", "station_id", "station_name", "latitude", "longitude",
        "total_start_count", "total_end_count",
    ],
    "fact_bike_daily_usage": [
        "bike_usage_key", "bike_id", "date_key", "hire_count",
        "daily_duration_minutes", "cumulative_duration_minutes",
    ],
    "dim_date": ["date_key", "year", "month", "quarter", "day_of_week", "day_type"],
    "alt_fact_hires": ["rental_id"],
    "alt_dim_station": ["station_key"],
}
UNIQUE = {
    "fact_hire": ["rental_id"],
    "dim_bike": ["bike_id"],
    "dim_station": ["station_key"],
    "dim_date": ["date_key"],
    "alt_fact_hires": ["rental_id"],
    "alt_dim_station": ["station_key"],
}
# Declared but switched off at the source for its cost; runs here.
EXTRA_UNIQUE = {"fact_bike_daily_usage": ["bike_usage_key"]}
RELATIONSHIPS = [
    ("fact_hire", "bike_id", "dim_bike", "bike_id"),
    ("fact_hire", "start_station_id", "dim_station", "station_id"),
    ("fact_hire", "end_station_id", "dim_station", "station_id"),
    ("fact_hire", "start_date_key", "dim_date", "date_key"),
    ("fact_hire", "end_date_key", "dim_date", "date_key"),
    ("fact_bike_daily_usage", "bike_id", "dim_bike", "bike_id"),
    ("fact_bike_daily_usage", "date_key", "dim_date", "date_key"),
    ("alt_fact_hires", "start_station_key", "alt_dim_station", "station_key"),
    ("alt_fact_hires", "end_station_key", "alt_dim_station", "station_key"),
]
ACCEPTED = [
    ("dim_date", "year", [*range(2015, 2024), 9999]),
    ("dim_date", "month", range(1, 13)),
    ("dim_date", "quarter", range(1, 5)),
    ("dim_date", "day_of_week", range(1, 8)),
    ("dim_date", "day_type", ["Weekday", "Weekend", "Unknown"]),
]


def _report(check: str, table: str, column, offenders: DataFrame) -> DataFrame:
    """One row: how many offending keys."""
    return offenders.agg(F.count("*").alias("failures")).select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        "failures",
    )


def links_of(tables: dict[str, DataFrame], child: str) -> list[tuple[str, DataFrame, str]]:
    return [(name, tables[parent], key) for table, name, parent, key in RELATIONSHIPS if table == child]


def _relationships(tables: dict[str, DataFrame], child: str) -> DataFrame:
    """One row per foreign key of ``child``, from one pass over it."""
    links = links_of(tables, child)
    columns = [name for name, *_ in links]
    found = quality.orphan_keys(tables[child], links)
    wide = found.agg(*[F.count_if(F.col("child_column") == name).alias(name) for name in columns])
    return wide.unpivot([], columns, "column_name", "failures").select(
        F.lit("relationships").alias("check"), F.lit(child).alias("table_name"), "column_name", "failures"
    )


def check_report(tables: dict[str, DataFrame], with_extra: bool = True) -> DataFrame:
    """(check, table, column, failures), one row per declared check; pass written tables.

    The NULL checks of a table share one pass over it, and so do its foreign keys.
    """
    parts = []
    for table, names in NOT_NULL.items():
        parts.append(
            quality.null_counts(tables[table], names).select(
                F.lit("not_null").alias("check"), F.lit(table).alias("table_name"), "column_name", "failures"
            )
        )
    declared = {**UNIQUE, **(EXTRA_UNIQUE if with_extra else {})}
    for table, names in declared.items():
        for name in names:
            parts.append(_report("unique", table, name, quality.unique_offenders(tables[table], name)))
    for child in dict.fromkeys(child for child, *_ in RELATIONSHIPS):
        parts.append(_relationships(tables, child))
    for table, name, accepted in ACCEPTED:
        offenders = quality.unaccepted_offenders(tables[table], name, accepted)
        parts.append(_report("accepted_values", table, name, offenders))
    return reduce(DataFrame.unionByName, parts)
