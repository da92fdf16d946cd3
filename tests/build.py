"""Hand-made tables: rows given as dicts, missing columns NULL."""

from __future__ import annotations

import datetime as dt

HIRES = (
    "rental_id long, duration long, duration_ms long, bike_id long, bike_model string,"
    " start_date timestamp_ntz, end_date timestamp_ntz, start_station_id long, start_station_name string,"
    " start_station_logical_terminal long, end_station_id long, end_station_name string,"
    " end_station_logical_terminal long, end_station_priority_id long"
)
STATIONS = "id long, name string, latitude double, longitude double, terminal_name long"
FACT = (
    "rental_id long, duration_minutes long, bike_id long, start_date timestamp_ntz, end_date timestamp_ntz,"
    " start_station_id long, end_station_id long, start_hour int, start_date_key date, end_date_key date"
)
DIM_BIKE = "bike_id long, bike_model string, total_duration_minutes long"
DIM_STATION = (
    "station_key string, station_id long, station_name string, latitude double, longitude double,"
    " total_start_count long, total_end_count long"
)


def table(spark, schema: str, rows: list[dict]):
    names = [field.split()[0] for field in schema.split(",")]
    for row in rows:
        assert set(row) <= set(names), set(row) - set(names)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def hires(spark, *rows: dict):
    """Hires with a bike, a start and an end unless said otherwise."""
    start = dt.datetime(2023, 1, 2, 8, 0)
    base = {"bike_id": 1, "start_date": start, "end_date": start + dt.timedelta(minutes=10), "duration": 600}
    return table(spark, HIRES, [{"rental_id": i, **base, **row} for i, row in enumerate(rows, 1)])


def stations(spark, *rows: dict):
    return table(spark, STATIONS, list(rows))


def rows(df, *columns: str) -> list[tuple]:
    """Sorted tuples of the chosen columns."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=repr)
