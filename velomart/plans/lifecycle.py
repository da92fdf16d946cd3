"""How long bikes serve: active against retired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.functions import columns as c
from velomart.operators.aggregates import exact_median

RETIRED_AFTER_DAYS = 14


def hire_spans(hires: DataFrame) -> DataFrame:
    """First start and last end per bike: the one pass over the hires everything here needs."""
    return hires.groupBy("bike_id").agg(
        F.expr("min(start_date) AS first_hire_date"), F.expr("max(end_date) AS last_hire_date")
    )


def bike_durations(spans: DataFrame) -> DataFrame:
    """Status and years in service per bike. Reads ``spans`` twice: pass a written table.

    Retired: last end more than 14 days before the latest end of all. A bike that never
    finished a hire counts as active, up to the latest end of all.
    """
    latest = spans.agg(F.max("last_hire_date")).scalar()
    retired = f"last_hire_date < latest_end_date - INTERVAL {RETIRED_AFTER_DAYS} DAY"
    until = f"if({retired}, last_hire_date, latest_end_date)"
    return (
        spans.withColumn("latest_end_date", latest)
        .select(
            "*",
            F.expr(f"if({retired}, 'retired', 'active') AS status"),
            c.micros_between("first_hire_date", until).alias("service_micros"),
        )
        .select("*", c.years("service_micros").alias("duration_years"))
    )


def lifecycle_detail(durations: DataFrame) -> DataFrame:
    return durations.selectExpr(
        "bike_id",
        "first_hire_date",
        "last_hire_date",
        "status",
        "round(duration_years, 4) AS duration_years",
    )


def lifecycle_summary(durations: DataFrame) -> DataFrame:
    """Mean, median, shortest and longest service per status.

    The median is exact. Reads ``durations`` three times: pass a plan over written spans, or a written table.
    """
    stats = durations.groupBy("status").agg(
        F.expr("round(avg(duration_years), 4) AS avg_duration_years"),
        F.expr("round(min(duration_years), 4) AS min_duration_years"),
        F.expr("round(max(duration_years), 4) AS max_duration_years"),
        F.expr("count(*) AS bike_count"),
    )
    middle = exact_median(durations, "status", "service_micros")
    median_years = (c.years("low") + c.years("high")) / 2
    return stats.join(middle, "status", "left").select(
        "status",
        "avg_duration_years",
        F.round(median_years, 4).alias("median_duration_years"),
        "min_duration_years",
        "max_duration_years",
        "bike_count",
    )


def lifecycle_histogram(durations: DataFrame) -> DataFrame:
    """Bikes per status and year bin, with the percentage of the status."""
    bins = durations.groupBy(
        "status",
        c.duration_bin("duration_years").alias("duration_bin"),
        c.duration_bin_order("duration_years").alias("bin_order"),
    ).agg(F.expr("count(*) AS bike_count"))
    # Five rows per status at most.
    return bins.selectExpr(
        "*", "round(bike_count * 100.0D / sum(bike_count) OVER (PARTITION BY status), 2) AS pct_of_group"
    )


def lifecycle_combined(durations: DataFrame) -> DataFrame:
    """Detail, summary and histogram as sections of one table of fifteen columns."""
    detail = lifecycle_detail(durations).selectExpr(
        "'detail' AS result_type",
        "1 AS section_id",
        "string(bike_id) AS bike_id",
        "string(first_hire_date) AS first_hire_date",
        "string(last_hire_date) AS last_hire_date",
        "status",
        "duration_years",
        "cast(NULL AS string) AS duration_bin",
        "cast(NULL AS double) AS avg_duration_years",
        "cast(NULL AS double) AS median_duration_years",
        "cast(NULL AS double) AS min_duration_years",
        "cast(NULL AS double) AS max_duration_years",
        "cast(NULL AS bigint) AS bike_count",
        "cast(NULL AS double) AS pct_of_group",
        "bigint(bike_id) AS sub_sort",
    )
    summary = lifecycle_summary(durations).selectExpr(
        "'summary' AS result_type", "2 AS section_id", "*", "0L AS sub_sort"
    )
    histogram = lifecycle_histogram(durations).selectExpr(
        "'histogram' AS result_type",
        "3 AS section_id",
        "status",
        "duration_bin",
        "bike_count",
        "pct_of_group",
        "bigint(bin_order) AS sub_sort",
    )
    sections = detail.unionByName(summary, allowMissingColumns=True).unionByName(
        histogram, allowMissingColumns=True
    )
    return sections.orderBy("section_id", "status", "sub_sort")


# The columns of each section when the combined table is split again.
SECTION_COLUMNS = {
    "detail": ["bike_id", "status", "duration_years"],
    "summary": ["status", "avg_duration_years", "bike_count"],
    "histogram": ["status", "duration_bin", "bike_count", "pct_of_group"],
}


def lifecycle_section(combined: DataFrame, section: str) -> DataFrame:
    return combined.where(f"result_type = '{section}'").select(*SECTION_COLUMNS[section])
