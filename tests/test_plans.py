"""Shape of the physical plans: what is shuffled, broadcast, pushed down."""

from __future__ import annotations

import pytest

from velomart.plans import altstar, demand, fleet, lifecycle, star, staging, stations, trend
from velomart.registry.queries import all_queries, short_hires
from velomart.sinks.tables import staged
from velomart.sources import bridge

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Raw tables as files, as an ingest leaves them."""
    return (
        staged(bridge.hires_from_events(spark, SF), "hires"),
        staged(bridge.stations_from_suppliers(spark, SF), "stations"),
    )


@pytest.fixture(scope="module")
def models(spark, raw):
    staged_hires = staging.stg_cycle_hire(*raw)
    return {
        "fact": staged(star.fact_hire(staged_hires), "fact"),
        "bike": staged(star.dim_bike(staged_hires), "bike"),
        "station": staged(star.dim_station(staged_hires, raw[1]), "station"),
    }


def test_staging_pushes_the_null_tests_and_broadcasts_only_station_sized_sides(raw):
    text = plan(staging.stg_cycle_hire(*raw))
    assert "IsNull(start_station_id)" in text and "IsNull(end_station_id)" in text
    assert "IsNotNull(bike_id)" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_names_for_both_lookups_are_shuffled_once(raw):
    df = staging.stg_cycle_hire(*raw)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("ReusedExchange") == 1


def test_station_counts_and_names_come_from_one_pass(raw):
    df = star.dim_station(staging.stg_cycle_hire(*raw), raw[1])
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    # hires: the lookups' pass and the main one; stations: two lookups and the coordinates
    assert final.count("FileScan parquet") == 5


def test_without_a_broadcast_staging_still_joins_by_key(spark, raw):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = staging.stg_cycle_hire(*raw)
        assert "BroadcastHashJoin" not in plan(df) and plan(df).count("SortMergeJoin") == 4
        without = sorted(map(repr, df.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert without == sorted(map(repr, staging.stg_cycle_hire(*raw).collect()))


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
}


@pytest.mark.parametrize("model", ["staging", "alternative fact"])
def test_hot_station_is_split_when_stations_are_too_large_to_broadcast(spark, raw, model):
    """A third of the hires start at one station and a third have no station at all."""
    hot = staged(
        raw[0].crossJoin(spark.range(60).withColumnRenamed("id", "n")).selectExpr(
            *[name for name in raw[0].columns if not name.startswith("start_station_")],
            "CASE n % 3 WHEN 0 THEN 4 WHEN 1 THEN start_station_id END AS start_station_id",
            "CASE n % 3 WHEN 0 THEN 'Station 4' WHEN 1 THEN start_station_name END AS start_station_name",
            "start_station_logical_terminal",
        ).repartition(16),
        "hot",
    )
    stations_list = staged(altstar.dim_station(hot), "dim")

    def build():
        if model == "staging":
            return staging.stg_cycle_hire(hot, raw[1]).groupBy("start_station_id").count()
        return altstar.fact_hires(hot, stations_list).groupBy("start_station_key").count()

    plain = build().collect()
    for key, value in SMALL_SKEW.items():
        spark.conf.set(key, value)
    try:
        split = build()
        assert sorted(split.collect()) == sorted(plain)
        assert "SortMergeJoin(skew=true)" in plan(split)
    finally:
        for key in SMALL_SKEW:
            spark.conf.unset(key)


def test_queries_read_only_the_columns_they_need(models):
    text = plan(demand.rides_by_hour(models["fact"]))
    assert "ReadSchema: struct<start_hour:int>" in text
    text = plan(fleet.active_bike_days(models["fact"].selectExpr("start_date_key AS date_key", "bike_id", "duration_minutes AS daily_duration_minutes")))
    assert "PushedFilters: [IsNotNull(start_date_key), IsNotNull(duration_minutes), GreaterThan(start" in text
    assert "ReadSchema: struct<duration_minutes:bigint,bike_id:bigint,start_date_key:date>" in text


def test_hires_are_counted_before_any_dimension_is_joined(models):
    for df in (
        stations.station_net_inflow(models["fact"], models["station"]),
        stations.top_start_stations(models["fact"], models["station"]),
        trend.trend_month_model(models["fact"], models["bike"]),
    ):
        text = plan(df)
        join = max(text.find(j) for j in ("BroadcastHashJoin", "SortMergeJoin"))
        assert 0 <= join < text.rfind("HashAggregate")  # an aggregate lies below the join
    assert "TakeOrderedAndProject" in plan(stations.top_start_stations(models["fact"], models["station"]))


def test_daily_usage_shuffles_only_days_with_hires(spark, models):
    """Below the rows multiplied by the calendar there are shuffles, above there are none."""
    from velomart.plans.calendar import dim_date

    dates = dim_date(spark)
    runs = star.usage_runs(models["fact"], models["bike"], dates)
    # Also as it is written: by month first, then days, sorted where they are.
    written = star.usage_days(star.usage_by_month(runs), dates).sortWithinPartitions("date_key", "bike_id")
    for text in (plan(star.usage_days(runs, dates)), plan(written)):
        upper = text[: text.index("Generate explode(sequence(from_day")]
        above = [line for line in upper.splitlines() if "Exchange" in line]
        assert all("BroadcastExchange" in line for line in above), above
        assert "CartesianProduct" not in text
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(written)


def test_dense_usage_gets_partitions_by_its_size(spark, models, monkeypatch):
    from velomart.plans.calendar import dim_date

    dates = dim_date(spark)
    monkeypatch.setattr(star, "DENSE_ROWS_PER_TASK", 1000)
    expected = -(-models["bike"].count() * (dates.count() - 1) // 1000)
    assert f", {expected})" in plan(star.usage_runs(models["fact"], models["bike"], dates))


def test_days_are_read_by_partition(spark):
    text = plan(all_queries()["active_bike_days"](spark, SF))
    assert "PartitionFilters: [isnotnull(date_key" in text


def test_latest_hire_is_limited_per_task_before_the_shuffle(models):
    assert "WindowGroupLimit" in plan(fleet.bike_last_location(models["fact"], models["bike"]))


def test_no_python_runs_in_any_plan(spark):
    for name in ("stg_cycle_hire", "dim_station", "fact_bike_daily_usage", "minute_profile", "profile_distinct"):
        text = plan(all_queries()[name](spark, SF))
        assert "Python" not in text and "ArrowEval" not in text and "Pandas" not in text, name


def test_alternative_fact_joins_the_written_station_list(spark, raw):
    dim = staged(altstar.dim_station(raw[0]), "dim")
    text = plan(altstar.fact_hires(raw[0], dim))
    assert text.count("BroadcastHashJoin") == 2


def test_lifecycle_reads_hires_once_when_staged(spark, models):
    durations = lifecycle.bike_durations(staged(lifecycle.hire_spans(models["fact"]), "spans"))
    assert "start_station_id" not in plan(lifecycle.lifecycle_combined(durations))


def test_calendar_filter_prunes_the_days_of_the_hires(spark, tmp_path):
    """Only weekend partitions are read; the filter comes from the calendar when the query runs."""
    query = all_queries()["weekend_rides"](spark, SF)
    text = plan(query)
    assert "dynamicpruning" in text and "LeftSemi" in text
    query.collect()
    nodes, metrics = [query._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            metrics.append(node.metrics().apply("numPartitions").value())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
    assert metrics and 0 < min(metrics) <= 10  # of 31 days


def test_lifecycle_summary_reads_the_spans_few_times(models):
    """Once for the figures, twice for the median; the latest end of all is one more scalar."""
    durations = staged(lifecycle.bike_durations(staged(lifecycle.hire_spans(models["fact"]), "spans")), "durations")
    assert plan(lifecycle.lifecycle_summary(durations)).count("FileScan parquet") == 3
