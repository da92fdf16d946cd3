"""The star schema: bikes, stations, hires, and daily use per bike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velomart.functions import columns as c
from velomart.plans.staging import locate, station_ends


def dim_bike(stg_hires: DataFrame) -> DataFrame:
    """One row per (bike, model) with the bike's total minutes over all its models.

    Hires are aggregated to (bike, model) before anything is shuffled by bike, so a bike with a
    huge share of the hires costs no more than any other; the window then sees one row per model.
    """
    per_model = stg_hires.groupBy("bike_id", "bike_model").agg(F.expr("sum(duration) AS seconds"))
    return per_model.select(
        "bike_id",
        "bike_model",
        c.whole_minutes("(sum(seconds) OVER (PARTITION BY bike_id))").alias("total_duration_minutes"),
    )


def dim_station(stg_hires: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations with their start and end counts; an id's counts repeat on each of its names.

    One pass over the hires yields the distinct stations and the counts together. ``by_name``
    is used twice; so that its shuffle runs once, both uses must need the same aggregate. Hence
    the unnamed stations are left out by a condition on the counts, which cannot move below
    the aggregate as a plain NULL test would.
    """
    by_name = (
        station_ends(stg_hires)
        .groupBy("station_id", "station_name")
        .agg(F.expr("sum(starts) AS starts"), F.expr("sum(ends) AS ends"))
    )
    by_id = by_name.groupBy("station_id").agg(
        F.expr("sum(starts) AS total_start_count"), F.expr("sum(ends) AS total_end_count")
    )
    named = by_name.where("(starts + ends) * int(station_name IS NOT NULL) > 0")
    return (
        locate(named.select("station_id", "station_name"), stations)
        .join(by_id, "station_id", "left")
        .selectExpr(
            "station_key",
            "station_id",
            "station_name",
            "latitude",
            "longitude",
            "coalesce(total_start_count, 0L) AS total_start_count",
            "coalesce(total_end_count, 0L) AS total_end_count",
        )
    )


def fact_hire(stg_hires: DataFrame) -> DataFrame:
    return stg_hires.select(
        "rental_id",
        F.coalesce(c.whole_minutes("duration"), F.lit(0)).alias("duration_minutes"),
        "bike_id",
        "start_date",
        "end_date",
        "start_station_id",
        "end_station_id",
        F.expr("hour(start_date) AS start_hour"),
        c.date_key("start_date").alias("start_date_key"),
        F.expr(f"coalesce(date(end_date), {c.open_end_day()}) AS end_date_key"),
    )


#: Rows of the daily usage that one task spreads out, about.
DENSE_ROWS_PER_TASK = 5_000_000


def usage_runs(hires: DataFrame, bikes: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per bike and day with hires, with the stretch of days on which it is the latest one.

    The running total is taken over the days with hires only; a bike's window holds at most one row
    per day. A bike with several model rows repeats each day that often, and since the running total is
    defined over a RANGE frame, peers on one day all show the sum over all of them.
    """
    days = dates.where(f"date_key <> {c.open_end_day()}").selectExpr("date_key AS day")
    model_rows = bikes.groupBy("bike_id").agg(F.expr("int(count(*)) AS model_rows"))

    # A start outside the calendar keeps its row, without a day: the bike was hired all the same.
    daily = (
        hires.groupBy("bike_id", "start_date_key")
        .agg(F.expr("count(*) AS hires"), F.expr("coalesce(sum(duration_minutes), 0L) AS minutes"))
        .join(days, F.expr("start_date_key = day"), "left")
        .drop("start_date_key")
    )
    # Rows grow about a hundredfold after this shuffle, so its partitions are set by the rows that will
    # be: adaptive execution would merge them by the size before the growth.
    spark = hires.sparkSession
    dense = bikes.count() * days.count()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dense // DENSE_ROWS_PER_TASK))
    daily = daily.repartition(partitions, "bike_id")
    in_order = Window.partitionBy("bike_id").orderBy(F.asc_nulls_last("day"))
    return (
        daily.select(
            "*",
            F.row_number().over(in_order).alias("nth"),
            F.lead("day").over(in_order).alias("next_day"),
            F.sum("minutes").over(in_order).alias("running"),
        )
        .where("day IS NOT NULL OR nth = 1")
        .join(model_rows, "bike_id")
        .withColumns(
            {
                "first_day": days.agg(F.min("day")).scalar(),
                "last_day": days.agg(F.max("day")).scalar(),
            }
        )
        .selectExpr(
            "bike_id",
            "day AS hire_day",
            "hires",
            "minutes",
            "running * model_rows AS running",
            # The first row also covers the days before the first hire.
            "if(nth = 1, first_day, day) AS from_day",
            "coalesce(date_sub(next_day, 1), last_day) AS to_day",
            "model_rows",
        )
    )


def usage_by_month(runs: DataFrame) -> DataFrame:
    """``usage_runs`` cut at the ends of months and brought together by month.

    A month is about a thirtieth of the rows that its days will be, so this is the place to shuffle.
    """
    cut = runs.selectExpr("*", "explode(sequence(trunc(from_day, 'MM'), trunc(to_day, 'MM'), INTERVAL 1 MONTH)) AS month")
    return (
        cut.withColumn("from_day", F.expr("greatest(from_day, month)"))
        .withColumn("to_day", F.expr("least(to_day, last_day(month))"))
        .hint("rebalance", "month")
        .drop("month")
    )


def usage_days(runs: DataFrame, dates: DataFrame) -> DataFrame:
    """Each run spread over its days, in place."""
    days = dates.where(f"date_key <> {c.open_end_day()}").selectExpr("date_key AS day")
    dense = runs.selectExpr("*", "explode(sequence(from_day, to_day)) AS day").join(days, "day", "left_semi")
    return dense.withColumnRenamed("day", "date_key").select(
        c.surrogate_key("bike_id", "date_key").alias("bike_usage_key"),
        "bike_id",
        "date_key",
        F.expr("if(date_key = hire_day, hires, 0L) AS hire_count"),
        F.expr("if(date_key = hire_day, minutes, 0L) AS daily_duration_minutes"),
        F.expr("if(date_key >= hire_day, running, 0L) AS cumulative_duration_minutes"),
        F.expr("explode(array_repeat(0, model_rows)) AS copy"),
    ).drop("copy")


def fact_bike_daily_usage(hires: DataFrame, bikes: DataFrame, dates: DataFrame) -> DataFrame:
    """Every hired bike on every day: hires, minutes and running minutes.

    The result is the cross product of bike rows and days, far larger than the days with hires, so each of
    those is spread over the days up to the bike's next one. The dense rows are never shuffled or sorted.
    """
    return usage_days(usage_runs(hires, bikes, dates), dates)
