"""One small table per rule of the models and queries."""

from __future__ import annotations

import datetime as dt
from datetime import date, datetime

import pytest
from build import DIM_BIKE, DIM_STATION, FACT, hires, rows, stations, table

from velomart.functions import columns as c
from velomart.operators import quality
from velomart.plans import altstar, calendar, demand, fleet, lifecycle, staging, star, stations as flow, trend


def fact(spark, *items):
    return table(spark, FACT, list(items))


# staging

def test_repeated_station_name_multiplies_the_hire(spark):
    raw = hires(spark, {"start_station_name": "A"})
    staged = staging.stg_cycle_hire(raw, stations(spark, {"id": 5, "name": "A"}, {"id": 6, "name": "A"}))
    assert rows(staged, "rental_id", "start_station_id") == [(1, 5), (1, 6)]
    assert rows(quality.unique_offenders(staged, "rental_id")) == [(1, 2)]


def test_repeated_name_multiplies_hires_with_an_id_too(spark):
    raw = hires(
        spark,
        {"start_station_name": "A"},
        {"start_station_name": "A", "start_station_id": 9},
        {"start_station_name": "B", "start_station_id": 8},
    )
    known = stations(
        spark, {"id": 5, "name": "A"}, {"id": 6, "name": "A"}, {"id": 7, "name": "B"}, {"id": 8, "name": "B"}
    )
    staged = staging.stg_cycle_hire(raw, known)
    # B is never missing an id, so its two stations do not multiply.
    assert rows(staged, "rental_id", "start_station_id") == [(1, 5), (1, 6), (2, 9), (2, 9), (3, 8)]


def test_start_station_ladder(spark):
    raw = hires(
        spark,
        {"start_station_id": 3, "start_station_name": "A", "start_station_logical_terminal": 1003},
        {"start_station_name": "A", "start_station_logical_terminal": 1004},
        {"start_station_name": "no such", "start_station_logical_terminal": 1005},
        {"start_station_name": "no such"},
        {},
    )
    staged = staging.stg_cycle_hire(raw, stations(spark, {"id": 5, "name": "A"}))
    assert rows(staged, "rental_id", "start_station_id") == [(1, 3), (2, 5), (3, 1005), (4, 0), (5, 0)]


def test_end_station_of_open_and_closed_hires(spark):
    raw = hires(
        spark,
        {"end_date": None},
        {"end_date": None, "end_station_id": 9, "end_station_name": "B"},
        {"end_station_id": None},
        {"end_date": None, "end_station_name": "A"},
        {"end_station_name": "A"},
    )
    staged = staging.stg_cycle_hire(raw, stations(spark, {"id": 5, "name": "A"}))
    assert rows(staged, "rental_id", "end_station_id", "end_station_name") == [
        (1, -1, "Unknown"), (2, 9, "B"), (3, 0, None), (4, -1, "A"), (5, 5, "A"),
    ]


def test_hire_without_bike_is_dropped_but_its_name_counts_as_missing(spark):
    raw = hires(
        spark,
        {"bike_id": None, "start_station_name": "A"},
        {"start_station_id": 1, "start_station_name": "A"},
    )
    staged = staging.stg_cycle_hire(raw, stations(spark, {"id": 5, "name": "A"}, {"id": 6, "name": "A"}))
    assert rows(staged, "rental_id", "start_station_id") == [(2, 1), (2, 1)]


def test_model_cleaning_differs_by_model(spark):
    raw = hires(spark, {"bike_model": ""}, {"bike_model": None}, {"bike_model": "  "})
    staged = staging.stg_cycle_hire(raw, stations(spark))
    assert rows(staged, "rental_id", "bike_model") == [(1, "CLASSIC"), (2, "CLASSIC"), (3, "  ")]
    monthly = altstar.dim_duration_by_month(raw)
    assert rows(monthly) == [(date(2023, 1, 1), "2023-01", "not_specified", 1800, 3)]


def test_stations_come_from_both_ends_and_need_a_name(spark):
    raw = hires(
        spark,
        {"start_station_id": 1, "start_station_name": "A", "end_station_id": 2, "end_station_name": "B"},
        {"start_station_id": 1, "start_station_name": "A2", "end_station_id": 3},
    )
    known = stations(spark, {"id": 1, "name": "A", "latitude": 51.0, "longitude": -0.1})
    staged = staging.stg_cycle_hire(raw, known)
    found = staging.stg_cycle_stations(staged, known)
    assert rows(found, "station_id", "station_name", "latitude", "longitude") == [
        (1, "A", 51.0, -0.1), (1, "A2", 51.0, -0.1), (2, "B", 0.0, 0.0),
    ]
    counted = star.dim_station(staged, known)
    assert rows(counted, "station_id", "station_name", "total_start_count", "total_end_count") == [
        (1, "A", 2, 0), (1, "A2", 2, 0), (2, "B", 0, 1),
    ]
    assert rows(counted, "station_key") == rows(found, "station_key")
    missing = quality.orphan_offenders(star.fact_hire(staged), "end_station_id", counted, "station_id")
    assert rows(missing) == [(3, 1)]


# star

def test_minutes_round_down_and_default_to_zero(spark):
    raw = hires(spark, {"duration": 59}, {"duration": 60}, {"duration": None}, {"duration": -1})
    built = star.fact_hire(staging.stg_cycle_hire(raw, stations(spark)))
    assert rows(built, "rental_id", "duration_minutes") == [(1, 0), (2, 1), (3, 0), (4, -1)]


def test_open_hire_ends_on_the_open_end_day(spark):
    built = star.fact_hire(staging.stg_cycle_hire(hires(spark, {"end_date": None}), stations(spark)))
    assert rows(built, "start_date_key", "end_date_key", "start_hour") == [
        (date(2023, 1, 2), date(9999, 1, 1), 8)
    ]


def test_two_model_bike_has_two_rows_with_one_total(spark):
    raw = hires(
        spark,
        {"bike_model": "CLASSIC", "duration": 90},
        {"bike_model": "PBSC_EBIKE", "duration": 90},
        {"bike_id": 2, "duration": None},
    )
    bikes = star.dim_bike(staging.stg_cycle_hire(raw, stations(spark)))
    assert rows(bikes) == [(1, "CLASSIC", 3), (1, "PBSC_EBIKE", 3), (2, "CLASSIC", None)]
    assert rows(quality.unique_offenders(bikes, "bike_id")) == [(1, 2)]


def short_calendar(spark, days=4):
    return calendar.dim_date(spark, date(2023, 1, 1), date(2023, 1, days))


def ride(n, bike, day, minutes):
    return {"rental_id": n, "bike_id": bike, "start_date_key": day, "duration_minutes": minutes}


def test_peers_of_a_two_model_bike_show_the_doubled_total(spark):
    bikes = table(spark, DIM_BIKE, [{"bike_id": 1, "bike_model": m} for m in ("CLASSIC", "PBSC_EBIKE")])
    usage = star.fact_bike_daily_usage(
        fact(spark, ride(1, 1, date(2023, 1, 1), 10)), bikes, short_calendar(spark, 1)
    )
    assert rows(usage, "hire_count", "daily_duration_minutes", "cumulative_duration_minutes") == [(1, 10, 20)] * 2


def test_days_without_hires_carry_the_running_total(spark):
    bikes = table(spark, DIM_BIKE, [{"bike_id": 1, "bike_model": "CLASSIC"}])
    facts = fact(spark, ride(1, 1, date(2023, 1, 1), 5), ride(2, 1, date(2023, 1, 3), 7), ride(3, 1, date(2023, 1, 3), 1))
    usage = star.fact_bike_daily_usage(facts, bikes, short_calendar(spark))
    assert rows(usage, "date_key", "hire_count", "daily_duration_minutes", "cumulative_duration_minutes") == [
        (date(2023, 1, 1), 1, 5, 5), (date(2023, 1, 2), 0, 0, 5),
        (date(2023, 1, 3), 2, 8, 13), (date(2023, 1, 4), 0, 0, 13),
    ]


def test_daily_usage_against_the_plain_definition(spark):
    """Late first hire, hires off the calendar, a gap in the calendar, a bike never hired."""
    spark_dates = short_calendar(spark, 8).where("date_key <> DATE'2023-01-04'")
    bikes = table(
        spark, DIM_BIKE,
        [{"bike_id": b, "bike_model": m} for b, m in [(1, "C"), (2, "C"), (2, "E"), (3, "C"), (4, "C")]],
    )
    facts = fact(
        spark,
        ride(1, 1, date(2023, 1, 3), 5), ride(2, 1, date(2023, 1, 4), 50), ride(3, 1, date(2023, 1, 6), 7),
        ride(4, 2, date(2022, 12, 31), 9), ride(5, 2, date(2023, 1, 8), 2), ride(6, 2, date(2023, 2, 1), 3),
        ride(7, 3, date(2022, 1, 1), 4), ride(8, 3, date(2024, 1, 1), 4),
    )
    for name, df in (("u_fact", facts), ("u_bike", bikes), ("u_date", spark_dates)):
        df.createOrReplaceTempView(name)
    plain = spark.sql(
        """SELECT b.bike_id, d.date_key, coalesce(i.n, 0) n, coalesce(i.m, 0) m,
                  sum(coalesce(i.m, 0)) OVER (PARTITION BY b.bike_id ORDER BY d.date_key) run
           FROM u_bike b CROSS JOIN u_date d
           LEFT JOIN (SELECT bike_id, start_date_key, count(*) n, sum(duration_minutes) m
                      FROM u_fact GROUP BY 1, 2) i ON i.bike_id = b.bike_id AND i.start_date_key = d.date_key
           WHERE d.date_key <> DATE'9999-01-01' AND b.bike_id IN (SELECT bike_id FROM u_fact)"""
    )
    usage = star.fact_bike_daily_usage(facts, bikes, spark_dates)
    wanted = ["bike_id", "date_key", "hire_count", "daily_duration_minutes", "cumulative_duration_minutes"]
    assert rows(usage, *wanted) == rows(plain)
    assert usage.count() == 7 * 4


# alternative star

def test_null_and_default_stations_match_each_other(spark):
    raw = hires(
        spark,
        {"start_station_name": "X", "end_station_id": 1, "end_station_name": "E"},
        {"start_station_name": "X", "start_station_id": 0, "end_station_id": 1, "end_station_name": "E"},
    )
    dim = altstar.dim_station(raw)
    assert dim.count() == 3
    built = altstar.fact_hires(raw, dim)
    assert [r[0] for r in rows(built, "rental_id")] == [1, 1, 2, 2]
    assert len(set(rows(built, "start_station_key"))) == 2
    assert "start_station_id" not in built.columns and "end_station_priority_id" in built.columns
    assert rows(altstar.fact_hires_listed(raw, dim), "rental_id") == rows(built, "rental_id")


def test_open_hires_form_a_month_of_their_own(spark):
    monthly = altstar.dim_duration_by_month(hires(spark, {"end_date": None, "duration": None}, {}))
    assert rows(monthly) == [
        (None, None, "not_specified", None, 1), (date(2023, 1, 1), "2023-01", "not_specified", 600, 1)
    ]


# calendar

def test_weekday_numbers_and_day_types(spark):
    dim = calendar.dim_date(spark, date(2023, 1, 1), date(2023, 1, 2))
    assert rows(dim) == [
        (date(2023, 1, 1), "2023", "1", "1", "7", "Weekend"),
        (date(2023, 1, 2), "2023", "1", "1", "1", "Weekday"),
        (date(9999, 1, 1), "9999", "1", "1", "5", "Unknown"),
    ]
    us = dim.where("year = '2023'").select(c.us_dow("date_key").alias("d"))
    assert rows(us) == [(1,), (2,)]


def test_full_calendar_size(spark):
    dim = calendar.dim_date(spark)
    assert dim.count() == 2953 + 1
    for column, accepted in [("year", [*range(2015, 2024), 9999]), ("day_type", ["Weekday", "Weekend", "Unknown"])]:
        assert quality.unaccepted_offenders(dim, column, accepted).count() == 0


# lifecycle

END = datetime(2023, 1, 15, 12, 0)


def life(n, bike, start, end):
    return {"rental_id": n, "bike_id": bike, "start_date": start, "end_date": end}


def test_active_and_retired_at_the_fourteen_day_border(spark):
    first = datetime(2022, 1, 1)
    facts = fact(
        spark,
        life(1, 1, first, END),
        life(2, 2, first, END - dt.timedelta(days=14)),
        life(3, 3, first, END - dt.timedelta(days=14, microseconds=1)),
        life(4, 4, first, None),
    )
    assert rows(lifecycle.bike_durations(lifecycle.hire_spans(facts)), "bike_id", "status") == [
        (1, "active"), (2, "active"), (3, "retired"), (4, "active")
    ]


def test_whole_years_open_the_next_bin(spark):
    year = dt.timedelta(seconds=31_557_600)
    facts = fact(spark, *[life(n, n, END - year * n, END) for n in (1, 2, 3, 4)],
                 life(9, 9, END - year + dt.timedelta(microseconds=1), END))
    bins = lifecycle.lifecycle_histogram(lifecycle.bike_durations(lifecycle.hire_spans(facts)))
    assert rows(bins, "bin_order", "duration_bin", "bike_count", "pct_of_group") == [
        (1, "0-1 yrs", 1, 20.0), (2, "1-2 yrs", 1, 20.0), (3, "2-3 yrs", 1, 20.0),
        (4, "3-4 yrs", 1, 20.0), (5, "4+ yrs", 1, 20.0),
    ]


def test_combined_sections_split_again(spark):
    year = dt.timedelta(seconds=31_557_600)
    facts = fact(spark, life(1, 7, END - year, END), life(2, 8, END - 2 * year, END), life(3, 9, END - 4 * year, END - 3 * year))
    durations = lifecycle.bike_durations(lifecycle.hire_spans(facts))
    combined = lifecycle.lifecycle_combined(durations)
    assert len(combined.columns) == 15
    assert [r.result_type for r in combined.collect()] == ["detail"] * 3 + ["summary"] * 2 + ["histogram"] * 3
    assert rows(lifecycle.lifecycle_section(combined, "detail")) == [
        ("7", "active", 1.0), ("8", "active", 2.0), ("9", "retired", 1.0)
    ]
    assert rows(lifecycle.lifecycle_section(combined, "summary")) == [("active", 1.5, 2), ("retired", 1.0, 1)]
    assert rows(lifecycle.lifecycle_summary(durations), "status", "median_duration_years") == [
        ("active", 1.5), ("retired", 1.0)
    ]


# demand

def test_peak_hours_include_both_ends(spark):
    labelled = spark.createDataFrame([(h,) for h in (6, 7, 9, 10, 16, 17, 19, 20)], "h int").select(
        "h", c.time_period("h").alias("p")
    )
    assert [p for _, p in sorted(labelled.collect())] == [
        "Off-Peak", "Morning Peak", "Morning Peak", "Off-Peak", "Off-Peak", "Evening Peak", "Evening Peak", "Off-Peak"
    ]


def test_modern_era_starts_at_first_month_by_model_and_share_counts_the_early_bucket(spark):
    monthly = spark.createDataFrame(
        [("2022-08", c.PRE_MODEL_ERA, 10), ("2022-09", c.PRE_MODEL_ERA, 6), ("2022-09", "CLASSIC", 3),
         ("2022-09", "PBSC_EBIKE", 1), ("2022-10", "CLASSIC", 4)],
        "year_month string, bike_model string, trip_count long",
    )
    modern = trend.trend_modern_era(monthly)
    assert modern.columns == ["year_month", "CLASSIC", "PBSC_EBIKE", c.PRE_MODEL_ERA]
    assert rows(modern) == [("2022-09", 3, 1, 6), ("2022-10", 4, 0, 0)]
    assert rows(trend.trend_share(monthly), "year_month", "bike_model", "pct_of_month") == [
        ("2022-09", "CLASSIC", 30.0), ("2022-09", "PBSC_EBIKE", 10.0), ("2022-09", c.PRE_MODEL_ERA, 60.0),
        ("2022-10", "CLASSIC", 100.0),
    ]
    assert rows(trend.trend_pivot(monthly))[0] == ("2022-08", 0, 0, 10)


def test_trips_of_a_two_model_bike_count_for_both_models(spark):
    facts = fact(
        spark,
        *[{"rental_id": n, "bike_id": 1, "start_date": d}
          for n, d in enumerate([datetime(2022, 9, 15, 23, 59, 59), datetime(2022, 9, 16)])],
    )
    bikes = table(spark, DIM_BIKE, [{"bike_id": 1, "bike_model": m} for m in ("CLASSIC", "PBSC_EBIKE")])
    assert rows(trend.trend_month_model(facts, bikes)) == [
        ("2022-09", "CLASSIC", 1), ("2022-09", "PBSC_EBIKE", 1), ("2022-09", c.PRE_MODEL_ERA, 2)
    ]


def test_series_drops_the_last_month(spark):
    rentals = spark.createDataFrame(
        [("2022", "4", "11", "Weekday", "1", 5), ("2022", "4", "11", "Weekend", "7", 7), ("2022", "4", "12", "Weekday", "1", 2),
         ("2023", "1", "1", "Weekday", "1", 1), ("2022", "3", "9", "Weekday", "1", 9)],
        "year string, quarter string, month string, day_type string, day_of_week string, total_rentals long",
    )
    assert [tuple(r) for r in demand.monthly_series(rentals).collect()] == [
        (date(2022, 9, 1), 9), (date(2022, 11, 1), 12), (date(2022, 12, 1), 2)
    ]
    assert rows(demand.weekday_winter_mean(rentals)) == [("1", 9.0, 8 / 3), ("7", None, 7.0)]
    assert rows(demand.weekday_winter_series(rentals)) == [
        (0, "Monday", False, 9.0), (0, "Monday", True, 8 / 3), (6, "Sunday", True, 7.0)
    ]


# stations

def station(i, name, starts=0, ends=0):
    return {"station_key": f"{i}-{name}", "station_id": i, "station_name": name,
            "total_start_count": starts, "total_end_count": ends}


def trip(n, start, end):
    return {"rental_id": n, "start_station_id": start, "end_station_id": end}


def test_net_inflow_keeps_losses_and_never_merges_unnamed_ends(spark):
    dim = table(spark, DIM_STATION, [station(1, "only starts"), station(2, "only ends"), station(3, "even")])
    facts = fact(spark, trip(1, 1, 2), trip(2, 1, 2), trip(3, 3, 3), trip(4, 99, 98), trip(5, 97, 98))
    assert rows(flow.station_net_inflow(facts, dim)) == [("only starts", 2, 0, -2), (None, 2, 0, -2)]


def test_net_inflow_counts_for_every_name_of_an_id(spark):
    dim = table(spark, DIM_STATION, [station(1, "old"), station(1, "new"), station(2, "b")])
    facts = fact(spark, trip(1, 1, 2), trip(2, 1, 2))
    assert rows(flow.station_net_inflow(facts, dim)) == [("new", 2, 0, -2), ("old", 2, 0, -2)]
    assert rows(flow.top_start_stations(facts, dim, 1)) == [("new", 2)]


def test_heat_adds_both_matches(spark):
    raw = stations(
        spark,
        {"id": 1, "name": "by id", "terminal_name": 1001, "latitude": 1.0, "longitude": 0.0},
        {"id": 2, "name": "by terminal", "terminal_name": 1002, "latitude": 2.0, "longitude": 0.0},
        {"id": 3, "name": "both", "terminal_name": 1003, "latitude": 3.0, "longitude": 0.0},
        {"id": 4, "name": "none", "terminal_name": 1004, "latitude": 4.0, "longitude": 0.0},
    )
    dim = table(
        spark, DIM_STATION,
        [station(1, "by id", 1, 2), station(1002, "by terminal", 3, 4), station(3, "both", 5, 0),
         station(1003, "both", 0, 6), station(4, "other name", 9, 9)],
    )
    heat = flow.station_heat(raw, dim)
    assert rows(heat) == [(1.0, 0.0, 3), (2.0, 0.0, 7), (3.0, 0.0, 11), (4.0, 0.0, 0)]
    assert rows(flow.station_heat_unmatched(raw, dim)) == [(4, "none", 1004)]
    assert rows(flow.heat_has_missing(heat)) == [(False, False, False)]


# fleet

def test_latest_hire_breaks_ties_and_ignores_open_hires(spark):
    end = datetime(2023, 1, 10)
    facts = fact(
        spark,
        {"rental_id": 1, "bike_id": 1, "end_date": end, "end_station_id": 5},
        {"rental_id": 2, "bike_id": 1, "end_date": end, "end_station_id": 6},
        {"rental_id": 3, "bike_id": 1, "end_date": None, "end_station_id": 7},
        {"rental_id": 4, "bike_id": 2, "end_date": None, "end_station_id": -1},
    )
    bikes = table(
        spark, DIM_BIKE,
        [{"bike_id": b, "bike_model": m, "total_duration_minutes": 9} for b, m in [(1, "PBSC_EBIKE"), (1, "CLASSIC"), (2, "CLASSIC")]],
    )
    idle = fleet.bike_idle_days(fleet.bike_last_location(facts, bikes))
    assert rows(idle, "bike_id", "bike_model", "end_station_id", "idle_days") == [
        (1, "CLASSIC", 6, 21.0), (2, "CLASSIC", -1, None)
    ]


def test_idle_days_have_a_fraction(spark):
    last = spark.createDataFrame([(1, datetime(2023, 1, 30, 12, 0, 0, 500))], "bike_id long, last_used timestamp_ntz")
    assert rows(fleet.bike_idle_days(last), "idle_days")[0][0] == pytest.approx(0.5 - 500 / 86_400e6, abs=1e-12)


# checks

def test_checks_report_offenders_and_let_nulls_pass(spark):
    child = spark.createDataFrame([(None,), (1,), (2,), (2,)], "k long")
    parent = spark.createDataFrame([(1,), (3,)], "k long")
    assert rows(quality.orphan_offenders(child, "k", parent, "k")) == [(2, 2)]
    assert rows(quality.unique_offenders(child, "k")) == [(2, 2)]
    assert quality.unique_offenders(spark.createDataFrame([(None,), (None,)], "k long"), "k").count() == 0
    assert quality.null_offenders(child, "k").count() == 1
    assert rows(quality.null_counts(child, ["k"])) == [("k", 1)]
    assert rows(quality.unaccepted_offenders(child, "k", [1])) == [(2, 2)]
