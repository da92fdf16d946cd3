"""Demand by calendar and time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c


def _per_day(hires: DataFrame, counted: str = "*") -> DataFrame:
    """Hires per start day: what the joins to the calendar run on instead of single hires."""
    return hires.groupBy("start_date_key").agg(F.expr(f"count({counted}) AS rides"))


def rides_by_weekday(hires: DataFrame, dates: DataFrame) -> DataFrame:
    return (
        _per_day(hires)
        .join(dates, F.expr("start_date_key = date_key"))
        .groupBy("day_of_week")
        .agg(F.expr("sum(rides) AS total_rides"))
        .orderBy(F.desc("total_rides"), "day_of_week")
    )


def rides_on_days(hires: DataFrame, dates: DataFrame, chosen: str) -> DataFrame:
    """(date_key, rides, minutes) of the calendar days that ``chosen`` is true for.

    A semi join of the hires to the filtered calendar, both written: where the hires are partitioned by day the days that
    are left of the calendar become a filter on the partitions when the query runs, and no other day is read.
    """
    days = dates.where(chosen).select(F.col("date_key").alias("start_date_key"))
    return (
        hires.join(days, "start_date_key", "left_semi")
        .groupBy(F.col("start_date_key").alias("date_key"))
        .agg(F.expr("count(*) AS rides"), F.expr("sum(duration_minutes) AS minutes"))
    )


def rides_by_hour(hires: DataFrame) -> DataFrame:
    return hires.groupBy("start_hour").agg(F.expr("count(*) AS total_rides")).orderBy("start_hour")


def rides_by_hour_ts(hires: DataFrame) -> DataFrame:
    """The same from the timestamp instead of the stored hour."""
    return (
        hires.groupBy(F.expr("hour(start_date) AS hour"))
        .agg(F.expr("count(*) AS total_rides"))
        .orderBy("hour")
    )


def peak_offpeak(hires: DataFrame) -> DataFrame:
    """Rides in the commuting peaks and outside, with their share of all rides."""
    periods = hires.groupBy(c.time_period("start_hour").alias("time_period")).agg(
        F.expr("count(*) AS total_rides")
    )
    # The window without partitions runs over the three period rows.
    return periods.selectExpr(
        "*", "total_rides * 100.0D / sum(total_rides) OVER () AS pct_of_total"
    ).orderBy(F.desc("total_rides"), "time_period")


def rentals_by_calendar(hires: DataFrame, dates: DataFrame) -> DataFrame:
    return (
        _per_day(hires, "rental_id")
        .join(dates, F.expr("start_date_key = date_key"))
        .groupBy("year", "quarter", "month", "day_type", "day_of_week")
        .agg(F.expr("sum(rides) AS total_rentals"))
        .orderBy("year", "quarter", "month", "day_of_week", "day_type")
    )


def monthly_series(rentals: DataFrame) -> DataFrame:
    """Rentals per month in date order, without the last, partial month."""
    monthly = rentals.groupBy(
        F.expr("make_date(int(year), int(month), 1) AS month_start")
    ).agg(F.expr("sum(total_rentals) AS total_rentals"))
    # The window without partitions runs over one row per month of the calendar.
    return (
        monthly.selectExpr("*", "max(month_start) OVER () AS last_month")
        .where("month_start < last_month")
        .drop("last_month")
        .orderBy("month_start")
    )


def weekday_winter_series(rentals: DataFrame) -> DataFrame:
    """Mean of the monthly totals per weekday (0 = Monday), winter apart from the rest."""
    return (
        rentals.select(
            (c.lenient_int("day_of_week") - 1).alias("weekday_index"),
            c.is_winter("month").alias("winter"),
            "total_rentals",
        )
        .groupBy("weekday_index", "winter")
        .agg(F.expr("avg(total_rentals) AS avg_monthly_total"))
        .select(
            "weekday_index", c.weekday_name("weekday_index").alias("weekday_name"),
            "winter", "avg_monthly_total",
        )
    )


def weekday_winter_mean(rentals: DataFrame) -> DataFrame:
    """The same means with winter unstacked into two columns."""
    return (
        rentals.withColumn("winter", c.is_winter("month"))
        .groupBy("day_of_week")
        .pivot("winter", [False, True])
        .agg(F.avg("total_rentals"))
        .selectExpr(
            "day_of_week", "`false` AS avg_monthly_total_other", "`true` AS avg_monthly_total_winter"
        )
    )


def minute_profile(hires: DataFrame) -> DataFrame:
    """Rentals per month, US weekday, weekend label, hour and minute."""
    weekday = c.us_dow("start_date")
    return hires.groupBy(
        F.expr("month(start_date) AS month"),
        weekday.alias("day_of_week"),
        F.when(weekday.isin(1, 7), "Weekend").otherwise("Weekday").alias("is_weekend"),
        F.expr("hour(start_date) AS hour"),
        F.expr("minute(start_date) AS minute"),
    ).agg(F.expr("count(rental_id) AS total_rentals"))


def minute_profile_labelled(profile: DataFrame) -> DataFrame:
    """The profile in time-of-day order with the winter flag and the fractional hour."""
    return profile.select(
        "*",
        c.is_winter("month").alias("winter"),
        F.expr("hour + minute / 60 AS time_of_day"),
    ).orderBy("hour", "minute")


def time_of_day_mean(profile: DataFrame) -> DataFrame:
    """Mean rentals over the month and weekday cells of each minute of the day."""
    return (
        minute_profile_labelled(profile)
        .groupBy("time_of_day", "is_weekend")
        .agg(F.expr("avg(total_rentals) AS avg_rentals"))
    )
