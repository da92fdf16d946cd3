"""Sources and sinks round trips."""

from __future__ import annotations

import datetime as dt
import threading
import time
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from build import hires, rows, stations

from velomart.plans import calendar
from velomart.plans.warehouse import STAR_TABLES, Warehouse, build_alternative, build_star
from velomart.sinks import tables as sinks
from velomart.sources import catalog, scans
from velomart.sources.registry import Source, SourceRegistry


def raw(spark):
    day = dt.datetime(2023, 1, 2, 8)
    return hires(
        spark,
        *[{"bike_id": n % 3 + 1, "start_date": day + dt.timedelta(days=n % 4), "start_station_id": n % 2 + 1,
           "start_station_name": f"S{n % 2 + 1}", "end_station_id": 1, "end_station_name": "S1"} for n in range(24)],
    ), stations(spark, {"id": 1, "name": "S1", "latitude": 51.5, "longitude": -0.1, "terminal_name": 1001})


def test_ingest_reads_shards_by_wildcard_and_checks_the_count(spark, tmp_path):
    hire, _ = raw(spark)
    for shard in range(3):
        hire.where(f"rental_id % 3 = {shard}").write.parquet(str(tmp_path / f"lake/x_cycle_hire_{shard}"))
    target = str(tmp_path / "raw/cycle_hire")
    for _ in range(2):  # a second load replaces the first
        assert scans.ingest(spark, str(tmp_path / "lake/*cycle_hire*"), target) == (24, 24)
    assert rows(sinks.read_published(spark, target)) == rows(hire)


def test_zone_aware_times_become_utc_without_zone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT TIMESTAMP'2022-07-01 12:00:00 Europe/London' AS t, 1 AS x").write.parquet(path)
    df = scans.scan_parquet(spark, path)
    assert dict(df.dtypes) == {"t": "timestamp_ntz", "x": "int"}
    assert df.first().t == dt.datetime(2022, 7, 1, 11)


def test_object_store_keys_come_from_the_environment():
    options = scans.object_store_options("store.example", "eu", {"s3_access_key_id": "a", "s3_secret_access_key": "b"})
    assert options["fs.s3a.access.key"] == "a" and options["fs.s3a.endpoint"] == "store.example"
    with pytest.raises(KeyError):
        scans.object_store_options("store.example", "eu", {})


def test_stations_from_csv(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("name,id,extra,latitude,longitude,terminal_name\nA,1,z,51.5,-0.1,1001\nB,2,z,bad,-0.2,\n")
    read = scans.scan_stations_csv(spark, str(path))
    assert rows(read) == [(1, "A", 51.5, -0.1, 1001, "z"), (2, "B", None, -0.2, None, "z")]
    assert rows(scans.unreadable_stations(spark, str(path))) == [("latitude", "bad", 1)]


def test_lines_of_the_csv_that_are_not_rows(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("name,id,latitude,longitude,terminal_name\nA,1,51.5,-0.1,1001\nB,2\nC,3,51.5,-0.1,1003,more\nB,2\n\"D, e\",x,51.5,-0.1,1004\n")
    assert rows(scans.unreadable_stations(spark, str(path))) == [("_line", "B,2", 2), ("_line", "C,3,51.5,-0.1,1003,more", 1), ("id", "x", 1)]
    assert sorted(r.name for r in scans.scan_stations_csv(spark, str(path)).collect()) == ["A", "B", "B", "C", "D, e"]


def test_a_curve_skips_row_groups_by_every_column(spark, tmp_path):
    """By footers: a linear sort skips by its first column only."""
    df = sinks.staged(
        spark.range(200_000).selectExpr("DATE'2023-01-01' AS d", "hash(id) & 1023 AS a", "if(id % 50 = 0, NULL, hash(id, 1) & 1023) AS b", "hash(id, 2) & 1023 AS c", "id")
    )
    options = {"parquet.block.size": 16384, "parquet.page.size": 2048, "parquet.block.row.check.min": 100}
    sinks.write_curve(df, str(tmp_path / "curve"), "d", ["a", "b", "c"], **options)
    df.repartitionByRange("d", "a", "b", "c").sortWithinPartitions("a", "b", "c").write.options(**options).partitionBy("d").parquet(str(tmp_path / "line"))
    assert rows(spark.read.parquet(str(tmp_path / "curve")).select(df.columns)) == rows(df)

    def share(name, column):
        seen = []
        for file in (tmp_path / name).glob("d=*/*.parquet"):
            footer = pq.ParquetFile(file).metadata
            place = footer.schema.names.index(column)
            stats = [footer.row_group(k).column(place).statistics for k in range(footer.num_row_groups)]
            seen += [s.has_min_max and s.min <= 500 <= s.max for s in stats]
        return sum(seen) / len(seen), len(seen)

    curve = {c: share("curve", c) for c in "abc"}
    assert min(n for _, n in curve.values()) > 15
    assert all(part < 0.6 for part, _ in curve.values()), curve
    assert share("line", "c")[0] > 0.9


def test_date_seed_keeps_text_columns(spark, tmp_path):
    path = str(tmp_path / "dim_date")
    made = calendar.dim_date(spark, date(2023, 1, 1), date(2023, 1, 3))
    made.write.option("header", True).csv(path)
    seed = scans.scan_date_seed(spark, path)
    assert seed.dtypes == made.dtypes and rows(seed) == rows(made)


def test_registry_switches_by_environment(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "local"))
    spark.range(5).write.saveAsTable("cloud_hires")
    sources = {"cycle_hire": {"local": Source(path=str(tmp_path / "loc*")), "cloud": Source(table="cloud_hires")}}
    assert SourceRegistry("local", sources).read(spark, "cycle_hire").count() == 3
    assert SourceRegistry("cloud", sources).read(spark, "cycle_hire").count() == 5
    spark.sql("DROP TABLE cloud_hires")


def test_catalog_lists_loads_and_profiles(spark):
    sinks.ensure_database(spark, "mart")
    sinks.ensure_database(spark, "mart")
    for name in ("mart.dim_bike", "mart.stg_cycle_hire", "mart.notes"):
        sinks.replace_table(spark.range(4), name)
        sinks.replace_table(spark.range(2), name)
    sinks.register_view(spark.range(1), "some_view")
    assert [t for t in catalog.list_tables(spark) if t[0] == "mart"] == [
        ("mart", "dim_bike"), ("mart", "notes"), ("mart", "stg_cycle_hire")
    ]
    assert catalog.list_columns(spark, "mart.dim_bike") == ["id"]
    frames = catalog.load_frames(spark, [("mart", "dim_bike"), ("mart", "stg_cycle_hire"), ("mart", "notes")])
    assert set(frames) == {"mart_bike_df", "mart_cycle_hire_df", "mart_notes_df"}
    assert catalog.frame_name("Dim_Station") == "station_df"
    assert catalog.frame_name("staging_x") == "x_df" and catalog.frame_name("dim_fact_x") == "fact_x_df"
    assert catalog.star_tables(["notes", "FACT_x"]) == ["FACT_x"] and catalog.star_tables(["a"]) == ["a"]
    assert rows(catalog.profile_database(spark, "mart")) == [("dim_bike", "id", 2)]
    assert catalog.describe(frames["mart_notes_df"]) == {"dtypes": {"id": "bigint"}, "shape": (2, 1)}


def test_copy_goes_on_after_any_failure_and_keeps_the_old_copy(spark, tmp_path):
    target = tmp_path / "out"
    broken = spark.createDataFrame([("x",)], "s string").selectExpr("cast(s AS int) AS n")
    spark.range(7).write.parquet(str(tmp_path / "damaged"))
    for file in (tmp_path / "damaged").glob("*.parquet"):
        file.write_bytes(b"not parquet at all")
    damaged = spark.read.schema("id long").parquet(str(tmp_path / "damaged"))
    early = sinks.copy_tables(spark, ["damaged", "b"], {"damaged": spark.range(2), "b": spark.range(9)}, str(target))
    assert early.where("succeeded").count() == 2
    names = ["a", "missing", "broken", "damaged", "b"]
    report = sinks.copy_tables(
        spark, names, {"a": spark.range(3), "b": spark.range(4), "broken": broken, "damaged": damaged}, str(target)
    )
    assert rows(report, "table_name", "row_count", "succeeded") == [
        ("a", 3, True), ("b", 4, True), ("broken", None, False), ("damaged", None, False), ("missing", None, False)
    ]
    errors = {r.table_name: r for r in report.collect()}
    assert errors["missing"].error_type == "KeyError" and errors["a"].error is None
    assert len(errors["damaged"].error) > 500
    assert sinks.read_published(spark, str(target / "b")).count() == 4
    assert sinks.read_published(spark, str(target / "damaged")).count() == 2
    assert len(list((target / "damaged").glob("v-*"))) == 1  # what the failed copy had written is gone


def test_warehouse_builds_partitioned_tables_twice(spark, tmp_path):
    hire, known = raw(spark)
    built = Warehouse(spark, str(tmp_path))
    dates = calendar.dim_date(spark, date(2023, 1, 1), date(2023, 1, 8))
    for _ in range(2):  # a rebuild replaces every table
        tables = build_star(built, hire, known, dates)
    assert sorted(tables) == sorted(STAR_TABLES)
    assert built.read("fact_hire").count() == 24
    assert tables["fact_bike_daily_usage"].count() == 3 * 8
    assert len(list((tmp_path / "fact_hire").glob("v-*"))) == 2
    assert len(list(Path(sinks.published(spark, str(tmp_path / "fact_hire"))).glob("start_date_key=*"))) == 4
    plan = tables["fact_hire"].where("start_date_key = DATE'2023-01-03'")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(start_date_key" in plan.toString()
    other = build_alternative(built, hire)
    assert other["alt_fact_hires"].count() == 24


def test_a_reader_finds_old_or_new_rows_at_every_moment(spark, tmp_path):
    hire, known = raw(spark)
    dates = calendar.dim_date(spark, date(2023, 1, 1), date(2023, 1, 8))
    built = Warehouse(spark, str(tmp_path / "mart"), "polled")
    build_star(built, hire, known, dates)
    seen, stop = set(), threading.Event()

    def poll():
        while not stop.is_set():
            try:
                seen.add((spark.table("polled.fact_hire").count(), spark.table("polled.dim_bike").count()))
                seen.add(sinks.read_published(spark, built.path("fact_hire")).count())
            except Exception as problem:
                seen.add(repr(problem)[:300])

    reader = threading.Thread(target=poll)
    reader.start()
    try:
        build_star(built, hire.unionByName(hire.withColumn("bike_id", F.col("bike_id") + 10)), known, dates)
        time.sleep(1)
    finally:
        stop.set()
        reader.join()
    assert seen - {24, 48} <= {(24, 3), (24, 6), (48, 3), (48, 6)} and {48, (48, 6)} <= seen
    spark.sql("DROP DATABASE polled CASCADE")


def test_catalog_table_is_replaced_whole_or_not_at_all(spark):
    sinks.ensure_database(spark, "swap")
    sinks.replace_table(spark.range(5), "swap.t")
    broken = spark.range(3).selectExpr("cast(if(id = 2, raise_error('no'), id) AS bigint) AS id")
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(broken, "swap.t")
    assert spark.table("swap.t").count() == 5
    sinks.replace_table(spark.table("swap.t").where("id > 1"), "swap.t")  # from its own rows
    assert rows(spark.table("swap.t")) == [(2,), (3,), (4,)]
    sinks.replace_table(spark.range(2).selectExpr("id", "'x' AS further"), "swap.t")
    assert rows(spark.table("swap.t")) == [(0, "x"), (1, "x")]
    sinks.replace_table(spark.range(2).selectExpr("'y' AS id"), "swap.t")
    assert rows(spark.table("swap.t")) == [("y",), ("y",)]
    days = spark.range(20).selectExpr("date_add(DATE'2023-01-01', int(id % 4)) AS d", "id")
    for _ in range(2):
        sinks.replace_table(days, "swap.days", "d", ["id"])
        assert spark.table("swap.days").where("d = DATE'2023-01-02'").count() == 5
    assert len(list(Path(sinks.table_root(spark, "swap.t").removeprefix("file:")).glob("v-*"))) == 2
    spark.sql("DROP DATABASE swap CASCADE")


def test_nothing_is_renamed():
    source = Path(sinks.__file__).read_text()
    assert ".rename(" not in source and 'mode("overwrite")' not in source


def test_jobs_run_together_and_a_slow_or_failing_one_delays_none(spark):
    ends = {}

    def slow(name, seconds):
        time.sleep(seconds)
        n = spark.range(10).count()
        ends[name] = time.perf_counter()
        return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("own")

    spark.sparkContext.setLocalProperty("own", "inherited")
    begun = time.perf_counter()
    done = sinks.run_together(spark, {"a": lambda: slow("a", 3), "b": lambda: 1 / 0, "c": lambda: slow("c", 0)}, 3)
    spark.sparkContext.setLocalProperty("own", None)
    assert done["a"] == (10, "a", "inherited") and done["c"] == (10, "c", "inherited")
    assert isinstance(done["b"], ZeroDivisionError) and ends["c"] < ends["a"] and time.perf_counter() - begun < 6
    assert list(done) == ["a", "b", "c"]


def test_shards_of_different_schema(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 2.5F AS x, DATE'2023-01-01' AS t, 'a' AS s, 1 AS k").write.parquet(str(tmp_path / "x_1"))
    spark.sql("SELECT 3000000000L AS ID, 7 AS x, TIMESTAMP_NTZ'2023-01-02 03:00:00' AS t, 5 AS s").write.parquet(str(tmp_path / "x_2"))
    spark.sql("SELECT 2 AS id, 1.5D AS x, TIMESTAMP'2023-07-02 03:00:00 Europe/London' AS t, 'b' AS s, 2 AS k, true AS more").write.parquet(str(tmp_path / "x_3"))
    df = scans.scan_parquet(spark, str(tmp_path / "x_*"))
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("t", "timestamp_ntz"), ("s", "string"), ("k", "int"), ("more", "boolean")]
    assert sorted(map(tuple, df.collect())) == [
        (1, 2.5, dt.datetime(2023, 1, 1), "a", 1, None),
        (2, 1.5, dt.datetime(2023, 7, 2, 2), "b", 2, True),
        (3_000_000_000, 7.0, dt.datetime(2023, 1, 2, 3), "5", None, None),
    ]
    found = {(r.column_name, r.shard_type): (r.read_as, r.shards) for r in scans.shard_differences(spark, str(tmp_path / "x_*")).collect()}
    assert found[("id", "int")] == ("bigint", 2) and found[("k", "missing")] == ("int", 1) and found[("more", "missing")] == ("boolean", 2)
    assert scans.shard_differences(spark, str(tmp_path / "x_1")).count() == 0


def test_a_failing_load_is_reported_and_delays_none(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "good"))
    report = scans.ingest_report(spark, {"none": (str(tmp_path / "no*"), str(tmp_path / "t0")), "good": (str(tmp_path / "go*"), str(tmp_path / "t1"))})
    assert rows(report) == [("good", 4, 4, True, None), ("none", None, None, False, "AnalysisException")]


def test_hot_day_is_split_over_several_files(spark, tmp_path):
    """A day with nearly all rows is written by several tasks, other days by one."""
    df = spark.range(400_000).selectExpr(
        "id", "md5(string(id)) AS filler", "if(id % 100 = 0, date_add(DATE'2023-01-01', int(id % 7)), DATE'2023-01-20') AS d"
    ).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        sinks.write_partitioned(df, str(tmp_path / "t"), "d", ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("d=*")}
    assert files["d=2023-01-20"] > 4 and files["d=2023-01-03"] == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000


def test_staged_table_lies_in_the_session_folder(spark):
    df = sinks.staged(spark.range(9), "nine")
    assert df.count() == 9
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_work_folder_is_one_per_application_and_can_be_released(spark, tmp_path):
    from pathlib import Path

    df = sinks.staged(spark.range(3), "three")
    folder = Path(sinks.run_folder(spark))
    assert folder.name == spark.sparkContext.applicationId and any(folder.iterdir()) and df.count() == 3
    sinks.release(spark)
    assert not folder.exists()
    assert sinks.staged(spark.range(2), "two").count() == 2


def test_default_calendar_covers_every_hire(spark, tmp_path):
    hire, known = raw(spark)
    late = hire.withColumn("start_date", F.expr("start_date + INTERVAL 16 MONTH")).withColumn("end_date", F.expr("end_date + INTERVAL 16 MONTH"))
    tables = build_star(Warehouse(spark, str(tmp_path)), hire.unionByName(late), known)
    assert calendar.uncovered_days(tables["fact_hire"], tables["dim_date"]).count() == 0
    assert calendar.uncovered_days(tables["fact_hire"], calendar.dim_date(spark)).agg(F.sum("hires")).first()[0] == 24
