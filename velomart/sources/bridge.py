"""Adapters: reshape the generic test tables into raw hires and raw stations.

``events`` gives one month of intraday hires with gaps and open hires; ``orders`` gives hires
over several years. Each has an SQL twin in ``registry/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns used of each test table; a declared schema saves reading the footers twice.
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE, props STRING"
SUPPLIER = "s_suppkey BIGINT, s_nationkey INT"
ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"


def _table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def hires_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``cycle_hire`` with every gap the cleaning rules handle."""
    return (
        _table(spark, sf_dir, "events", EVENTS)
        .selectExpr(
            "event_id",
            "user_id",
            "floor(value * 60) AS secs",
            "cast(date_trunc('second', ts - INTERVAL 12 MONTH) AS timestamp_ntz) AS begins",
            "cast(get_json_object(props, '$.k') AS bigint) + 1 AS k",
            "(event_id * 7 + user_id) % 110 + 1 AS e",
        )
        .selectExpr(
            "event_id AS rental_id",
            "if(event_id % 89 = 0, NULL, secs) AS duration",
            "if(event_id % 89 = 0, NULL, secs * 1000) AS duration_ms",
            "if(event_id % 97 = 0, NULL, user_id) AS bike_id",
            """CASE WHEN user_id % 4 = 0 OR (user_id = 7 AND event_id % 2 = 0) THEN 'PBSC_EBIKE'
                    WHEN user_id % 4 = 1 THEN 'CLASSIC' WHEN user_id % 4 = 2 THEN '' END AS bike_model""",
            "begins AS start_date",
            "if(event_id % 53 = 0, NULL, timestampadd(SECOND, secs, begins)) AS end_date",
            """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 AND k % 10 = 0 THEN 0
                    ELSE k END AS start_station_id""",
            """CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 223 = 0 THEN ''
                    ELSE concat('Station ', k) END AS start_station_name""",
            "if(event_id % 2 = 0, k + 1000, NULL) AS start_station_logical_terminal",
            "if(event_id % 7 = 0, NULL, e) AS end_station_id",
            "if(event_id % 199 = 0, NULL, concat('Station ', e)) AS end_station_name",
            "if(event_id % 3 = 0, e + 1000, NULL) AS end_station_logical_terminal",
            "cast(NULL AS bigint) AS end_station_priority_id",
        )
    )


def stations_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``cycle_stations``; every seventh name belongs to two, every seventeenth is never used."""
    return (
        _table(spark, sf_dir, "supplier", SUPPLIER)
        .selectExpr("s_suppkey + 1 AS number", "cast(s_nationkey AS double) AS nation")
        .selectExpr(
            "number",
            "nation",
            "explode(if(number % 7 = 0, array(0, 1000000), array(0))) AS shift",
        )
        .selectExpr(
            "number + shift AS id",
            "concat(if(number % 17 = 0, 'Dock ', 'Station '), number) AS name",
            "51.5D + nation * 0.01D AS latitude",
            "-0.1D - nation * 0.01D AS longitude",
            "number + shift + 1000 AS terminal_name",
        )
    )


def hires_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``cycle_hire`` from mid-2016 to early 2023, complete but for open hires."""
    return (
        _table(spark, sf_dir, "orders", ORDERS)
        .selectExpr(
            "o_orderkey",
            "o_custkey",
            "timestampadd(SECOND, o_orderkey % 86400, o_orderdate + INTERVAL 258 MONTH) AS begins",
            "floor(o_totalprice / 100) AS secs",
            "o_orderkey % 90 + 1 AS k",
            "o_custkey % 90 + 1 AS e",
        )
        .selectExpr(
            "o_orderkey AS rental_id",
            "secs AS duration",
            "secs * 1000 AS duration_ms",
            "o_custkey AS bike_id",
            """CASE WHEN o_custkey % 3 = 0 THEN 'PBSC_EBIKE' WHEN o_custkey % 3 = 1 THEN 'CLASSIC'
                    WHEN o_orderkey % 2 = 0 THEN 'PBSC_EBIKE' END AS bike_model""",
            "begins AS start_date",
            "if(o_orderkey % 53 = 0, NULL, timestampadd(SECOND, secs, begins)) AS end_date",
            "k AS start_station_id",
            "concat('Station ', k) AS start_station_name",
            "k + 1000 AS start_station_logical_terminal",
            "e AS end_station_id",
            "concat('Station ', e) AS end_station_name",
            "e + 1000 AS end_station_logical_terminal",
            "cast(NULL AS bigint) AS end_station_priority_id",
        )
    )
