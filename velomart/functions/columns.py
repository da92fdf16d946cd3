"""Column expressions: keys, cleaned labels, station defaults and time arithmetic.

Everything here returns a ``Column`` parsed from SQL text (one call to the JVM each) and made of
built-in functions, so it stays inside whole-stage codegen. Arguments are column names or SQL
text. Timestamps are ``TIMESTAMP_NTZ``; nothing depends on the session zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql.functions import expr

# Fixed values of the data model.
OPEN_END_DATE = dt.date(9999, 1, 1)  # date key of a hire that has not ended
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"  # stands for NULL inside a surrogate key
DEFAULT_MODEL = "CLASSIC"
UNSPECIFIED_MODEL = "not_specified"
UNKNOWN_STATION = "Unknown"
NO_STATION_ID = 0  # station could not be identified
IN_USE_STATION_ID = -1  # hire still open, so no end station yet
PRE_MODEL_ERA = "Pre-Model Era"
MODEL_ERA_START = "2022-09-16"
SECONDS_PER_YEAR = 31_557_600
WINTER_MONTHS = (1, 2, 11, 12)
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def open_end_day() -> str:
    """The open-end day as an SQL literal."""
    return f"DATE'{OPEN_END_DATE}'"


def date_key(column: str) -> Column:
    """Timestamp to calendar day."""
    return expr(f"cast({column} AS date)")


def surrogate_key(*columns: str) -> Column:
    """md5 over the columns as text, NULLs replaced by a token, joined by '-'."""
    parts = ", ".join(f"coalesce(cast({c} AS string), '{NULL_KEY_TOKEN}')" for c in columns)
    return expr(f"md5(concat_ws('-', {parts}))")


def staged_model(column: str = "bike_model") -> Column:
    """Missing or empty model is CLASSIC; blanks are kept as they are."""
    return expr(f"coalesce(nullif({column}, ''), '{DEFAULT_MODEL}')")


def reported_model(column: str = "bike_model") -> Column:
    """Missing, empty or blank model is 'not_specified'."""
    return expr(f"coalesce(nullif(trim({column}), ''), '{UNSPECIFIED_MODEL}')")


def start_station_id() -> Column:
    """Own id, else the station found by name, else the terminal, else 0."""
    return expr(
        f"coalesce(start_station_id, found_start_id, start_station_logical_terminal, {NO_STATION_ID}L)"
    )


def end_station_id() -> Column:
    """As for the start once the hire has ended; an open hire has its own id or -1."""
    return expr(
        f"""if(end_date IS NULL,
               coalesce(end_station_id, {IN_USE_STATION_ID}L),
               coalesce(end_station_id, found_end_id, end_station_logical_terminal, {NO_STATION_ID}L))"""
    )


def end_station_name() -> Column:
    """An open hire without a station name ends at 'Unknown'."""
    return expr(f"if(end_date IS NULL, coalesce(end_station_name, '{UNKNOWN_STATION}'), end_station_name)")


def whole_minutes(seconds: str) -> Column:
    """Seconds to whole minutes, rounding down (also below zero)."""
    return expr(f"floor({seconds} / 60)")


def month_label(column: str) -> Column:
    return expr(f"date_format(cast({column} AS date), 'yyyy-MM')")


def month_start(column: str) -> Column:
    return expr(f"trunc(cast({column} AS date), 'month')")


def iso_dow(column: str) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return expr(f"weekday(cast({column} AS date)) + 1")


def us_dow(column: str) -> Column:
    """1 = Sunday .. 7 = Saturday."""
    return expr(f"dayofweek(cast({column} AS date))")


def weekday_name(index: str) -> Column:
    """0-based ISO weekday index to its English name."""
    names = ", ".join(f"'{name}'" for name in WEEKDAY_NAMES)
    return expr(f"element_at(array({names}), {index} + 1)")


def is_winter(month: str) -> Column:
    return expr(f"cast({month} AS int) IN {WINTER_MONTHS}")


def micros_between(start: str, end: str) -> Column:
    """Exact microseconds from ``start`` to ``end`` without going through a time zone."""
    gap = f"({end} - {start})"
    minutes = (
        f"((extract(DAY FROM {gap}) * 24L + extract(HOUR FROM {gap})) * 60 + extract(MINUTE FROM {gap}))"
    )
    return expr(f"{minutes} * 60000000 + cast(extract(SECOND FROM {gap}) * 1000000 AS bigint)")


def years(micros: str) -> Column:
    return expr(f"{micros} / {MICROS_PER_SECOND} / {SECONDS_PER_YEAR}")


def duration_bin(value: str) -> Column:
    return expr(
        f"""CASE WHEN {value} < 1 THEN '0-1 yrs' WHEN {value} < 2 THEN '1-2 yrs'
                 WHEN {value} < 3 THEN '2-3 yrs' WHEN {value} < 4 THEN '3-4 yrs' ELSE '4+ yrs' END"""
    )


def duration_bin_order(value: str) -> Column:
    return expr(
        f"""CASE WHEN {value} < 1 THEN 1 WHEN {value} < 2 THEN 2
                 WHEN {value} < 3 THEN 3 WHEN {value} < 4 THEN 4 ELSE 5 END"""
    )


def time_period(hour: str) -> Column:
    """Commuting peaks, both ends included."""
    return expr(
        f"""CASE WHEN {hour} BETWEEN 7 AND 9 THEN 'Morning Peak'
                 WHEN {hour} BETWEEN 17 AND 19 THEN 'Evening Peak' ELSE 'Off-Peak' END"""
    )


def zero_if_missing(*columns: str) -> Column:
    """Sum of the columns, each NULL counted as 0."""
    return expr(" + ".join(f"coalesce({c}, 0)" for c in columns))


def lenient_int(column: str) -> Column:
    """Text to integer, NULL where the text is no number."""
    return expr(f"try_cast({column} AS int)")


def utc_ntz(column: str) -> Column:
    """Zone-aware timestamp to its UTC wall-clock time without a zone."""
    return expr(f"timestampadd(MICROSECOND, unix_micros(`{column}`), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
