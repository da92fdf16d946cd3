"""Scans of files: Parquet by wildcard, stations from CSV, the date seed; raw ingest."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velomart.functions import columns as c
from velomart.plans.calendar import DIM_DATE_SCHEMA
from velomart.sinks.tables import publish, read_published, run_together, write_counted

STATIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("terminal_name", T.LongType()),
    ]
)


def object_store_options(endpoint: str, region: str, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Reader options for an S3-compatible store; the keys come from the environment only."""
    return {
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.endpoint.region": region,
        "fs.s3a.access.key": env["s3_access_key_id"],
        "fs.s3a.secret.key": env["s3_secret_access_key"],
    }


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def shard_schemas(spark: SparkSession, pattern: str, options: Mapping[str, str] | None = None) -> dict[str, T.StructType]:
    """The schema of every file or folder that matches a wildcard, from one footer of each."""
    read = spark.read.options(**(options or {}))
    found = run_together(spark, {path: lambda path=path: read.parquet(path).schema for path in _matches(spark, pattern)}, 8)
    for schema in found.values():
        if isinstance(schema, Exception):
            raise schema
    return found


# Numeric types from narrow to wide.
NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type that a column is read as whose shards differ: the widest number, the finest time, else text."""
    names = [t.simpleString() for t in types]
    if len(set(names)) == 1:
        return types[0]
    if all(n in NUMBERS for n in names):
        whole = {"int", "bigint"} & set(names)
        widest = max(types, key=lambda t: NUMBERS.index(t.simpleString()))
        return T.DoubleType() if whole and widest == T.FloatType() else widest
    if set(names) <= {"date", "timestamp", "timestamp_ntz"}:
        return T.TimestampNTZType()
    return T.StringType()


def reconciled(schemas: Iterable[T.StructType]) -> T.StructType:
    """One schema for shards that differ: columns by name whatever their case, in the order they are met."""
    types: dict[str, list[T.DataType]] = {}
    spelled: dict[str, str] = {}
    for schema in schemas:
        for field in schema:
            spelled.setdefault(field.name.lower(), field.name)
            types.setdefault(field.name.lower(), []).append(field.dataType)
    return T.StructType([T.StructField(spelled[key], common_type(own)) for key, own in types.items()])


def shard_differences(spark: SparkSession, pattern: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """(column_name, shard_type, read_as, shards): columns that are missing from some shards, or of another type there than read."""
    schemas = list(shard_schemas(spark, pattern, options).values())
    counts: Counter[tuple[str, str, str]] = Counter()
    for field in reconciled(schemas):
        for schema in schemas:
            own = [f.dataType.simpleString() for f in schema if f.name.lower() == field.name.lower()]
            counts[field.name, own[0] if own else "missing", field.dataType.simpleString()] += 1
    rows = [(*key, n) for key, n in counts.items() if n < len(schemas) or key[1] != key[2]]
    return spark.createDataFrame(rows, "column_name string, shard_type string, read_as string, shards long")


def _read_as(df: DataFrame, schema: T.StructType) -> DataFrame:
    own = {name.lower(): name for name in df.columns}
    kinds = dict(df.dtypes)
    columns = []
    for field in schema:
        name = own.get(field.name.lower())
        value = F.lit(None) if name is None else c.utc_ntz(name) if kinds[name] == "timestamp" else F.col(f"`{name}`")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def scan_parquet(spark: SparkSession, pattern: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """All Parquet files matching a wildcard; zone-aware times become UTC times without zone.

    Shards may differ in their columns: each group of equal schema is read as it is, cast to the
    ``reconciled`` schema and put together by name; a column that a shard lacks is NULL there.
    """
    groups: dict[str, list[str]] = {}
    schemas = shard_schemas(spark, pattern, options)
    for path, schema in schemas.items():
        groups.setdefault(schema.json(), []).append(path)
    read = spark.read.options(**(options or {}))
    if len(groups) > 1:
        whole = reconciled(schemas.values())
        zoned = [f for f in whole if f.dataType == T.TimestampType()]
        for field in zoned:
            field.dataType = T.TimestampNTZType()
        parts = [_read_as(read.schema(schemas[paths[0]]).parquet(*paths), whole) for paths in groups.values()]
        return reduce(DataFrame.unionByName, parts)
    df = read.parquet(pattern)
    zoned = [f.name for f in df.schema if f.dataType == T.TimestampType()]
    return df.withColumns({name: c.utc_ntz(name) for name in zoned}) if zoned else df


LINE = "_line"


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV with a header as text, and in ``_line`` the whole of lines with too few or too many fields."""
    names = spark.read.option("header", True).csv(path).columns  # reads the header line only
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, LINE]])
    # Without pruning, as otherwise only the fields asked for are counted.
    options = {"header": True, "columnNameOfCorruptRecord": LINE, "columnPruning": False}
    return spark.read.schema(schema).options(**options).csv(path)


def scan_stations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Stations from CSV with a header: the known columns typed and first, further ones kept as text.

    A value that cannot be read as its type becomes NULL here, as does a field that a line lacks; ``unreadable_stations``
    reports both.
    """
    lines = _csv_lines(spark, path)
    known = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in STATIONS_SCHEMA]
    further = [F.col(f"`{name}`") for name in lines.columns if name not in (*STATIONS_SCHEMA.names, LINE)]
    return lines.select(*known, *further)


def unreadable_stations(spark: SparkSession, path: str) -> DataFrame:
    """(column_name, value, rows): texts in the stations CSV that are not of their column's type.

    Lines with too few or too many fields are reported whole, under the column name ``_line``.
    """
    wrong = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.col(f.name)).alias(f.name)
        for f in STATIONS_SCHEMA
    ]
    names = [*STATIONS_SCHEMA.names, LINE]
    return (
        _csv_lines(spark, path)
        .select(*wrong, LINE)
        .unpivot([], names, "column_name", "value")
        .where("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("rows"))
    )


def scan_date_seed(spark: SparkSession, path: str) -> DataFrame:
    """The date dimension from CSV: a date key, all other columns text."""
    return spark.read.option("header", True).schema(DIM_DATE_SCHEMA).csv(path)


def ingest(
    spark: SparkSession, pattern: str, target: str, options: Mapping[str, str] | None = None
) -> tuple[int, int]:
    """Load files matching ``pattern`` into the raw table at ``target``, replacing it; ``read_published`` reads it.

    Returns (rows read, rows in the written table); the load is sound if they are equal.
    """
    source = scan_parquet(spark, pattern, options)
    read = []
    publish(spark, target, lambda folder: read.append(write_counted(source, lambda df: df.write.parquet(folder))))
    return read[0], read_published(spark, target).count()


def ingest_report(
    spark: SparkSession, loads: Mapping[str, tuple[str, str]], options: Mapping[str, str] | None = None, at_once: int = 4
) -> DataFrame:
    """Ingest several raw tables given as name -> (pattern, target), read with ``options``; one row per table.

    Several at once; a load that fails is reported with its kind of error and leaves what was at its target.
    """
    jobs = {name: lambda x=x: ingest(spark, *x, options) for name, x in loads.items()}
    done = run_together(spark, jobs, at_once)
    rows = [
        (name, None, None, False, type(x).__name__) if isinstance(x, Exception) else (name, *x, x[0] == x[1], None)
        for name, x in done.items()
    ]
    return spark.createDataFrame(
        rows, "table_name string, rows_read long, rows_loaded long, complete boolean, error_type string"
    )
