"""Catalog access: list tables and columns, load chosen tables as named frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from velomart.operators.aggregates import table_profile

# Name prefixes by table role, in the order they are tried.
NAME_PREFIXES = ("dim_", "fact_", "stg_", "staging_")
STAR_PREFIXES = ("fact_", "dim_")
SYSTEM_DATABASES = ("information_schema", "pg_catalog", "global_temp")


def list_tables(spark: SparkSession) -> list[tuple[str, str]]:
    """(database, table) of every user table, in order."""
    found = []
    for database in spark.catalog.listDatabases():
        if database.name in SYSTEM_DATABASES:
            continue
        for table in spark.catalog.listTables(database.name):
            if not table.isTemporary:
                found.append((database.name, table.name))
    return sorted(found)


def list_columns(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table)]


def describe(df: DataFrame) -> dict:
    """Column types and shape; counting runs a job."""
    return {"dtypes": dict(df.dtypes), "shape": (df.count(), len(df.columns))}


def star_tables(names: Iterable[str]) -> list[str]:
    """The fact and dimension tables among the names; all names if there are none."""
    names = list(names)
    return [n for n in names if n.lower().startswith(STAR_PREFIXES)] or names


def frame_name(table: str, database: str = "default") -> str:
    """``dim_station`` -> ``station_df``; a database other than the default is prefixed."""
    name = table.lower()
    for prefix in NAME_PREFIXES:
        if name.startswith(prefix):
            name = name.removeprefix(prefix)
            break
    return f"{name}_df" if database == "default" else f"{database}_{name}_df"


def load_frames(spark: SparkSession, tables: Iterable[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Named frames for (database, table) pairs, all user tables by default; nothing is read yet."""
    chosen = list_tables(spark) if tables is None else tables
    return {
        frame_name(table, database): spark.read.table(f"`{database}`.`{table}`")
        for database, table in chosen
    }


def profile_database(spark: SparkSession, database: str = "default") -> DataFrame:
    """Distinct counts of every column of the database's star tables."""
    names = star_tables(table for base, table in list_tables(spark) if base == database)
    return table_profile({name: spark.read.table(f"`{database}`.`{name}`") for name in names})
