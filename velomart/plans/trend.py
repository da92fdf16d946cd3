"""Monthly trips by bike model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c


def trend_month_model(hires: DataFrame, bikes: DataFrame, cutoff: str = c.MODEL_ERA_START) -> DataFrame:
    """Trips per month and model, all trips before ``cutoff`` in one bucket.

    Hires are counted per (month, era, bike) first, so the join to the bike rows sees one row
    per bike and month instead of one per hire. A bike with two models counts for both.
    """
    per_bike = (
        hires.where("start_date IS NOT NULL")
        .groupBy(
            c.month_label("start_date").alias("year_month"),
            F.expr(f"start_date < TIMESTAMP_NTZ'{cutoff} 00:00:00' AS before_models"),
            "bike_id",
        )
        .agg(F.expr("count(*) AS trips"))
    )
    label = F.expr(f"if(before_models, '{c.PRE_MODEL_ERA}', bike_model) AS bike_model")
    return (
        per_bike.join(bikes.select("bike_id", "bike_model"), "bike_id")
        .groupBy("year_month", label)
        .agg(F.expr("sum(trips) AS trip_count"))
    )


def trend_pivot(trend: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row per month, one column per model, 0 where there were no trips.

    Without ``models`` Spark looks the column names up in ``trend``, so pass a written table.
    """
    return trend.groupBy("year_month").pivot("bike_model", models).agg(F.sum("trip_count")).na.fill(0)


def _from_modern_start(months: DataFrame, trend: DataFrame) -> DataFrame:
    """Rows of ``months`` from the first month in ``trend`` with trips by model on."""
    by_model = trend.where(f"bike_model <> '{c.PRE_MODEL_ERA}' AND trip_count > 0")
    first = by_model.agg(F.min("year_month")).scalar()
    return months.where(F.col("year_month") >= first)


def trend_modern_era(trend: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The pivot from the first month with trips by model on; the early bucket stays a column."""
    return _from_modern_start(trend_pivot(trend, models), trend)


def trend_share(trend: DataFrame) -> DataFrame:
    """Percent of each modern month's trips by model; a month's rows are one per model."""
    return _from_modern_start(trend, trend).selectExpr(
        "year_month",
        "bike_model",
        "trip_count",
        "trip_count / sum(trip_count) OVER (PARTITION BY year_month) * 100.0D AS pct_of_month",
    )


def trend_share_pivot(trend: DataFrame, models: list[str] | None = None) -> DataFrame:
    """``trend_share`` with one column per model, 0 where a model had no trips."""
    share = trend_share(trend)
    return share.groupBy("year_month").pivot("bike_model", models).agg(F.sum("pct_of_month")).na.fill(0)
