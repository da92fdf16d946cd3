"""Sketches per partition against exact counts."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from build import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velomart.operators.aggregates import distinct_counts
from velomart.operators.profiles import (
    STORED, error_bound, merged_profile, partition_sketches, partition_states, refresh_sketches,
)
from velomart.plans.warehouse import Warehouse
from velomart.sinks.tables import publish


def exact(df, partition):
    return {r.column_name: r.distinct_count for r in distinct_counts(df.drop(partition)).collect()}


def estimates(sketches):
    return {r.column_name: r.distinct_estimate for r in merged_profile(sketches).collect()}


@pytest.fixture(scope="module")
def hires(spark):
    """200,000 rows over 40 days, one of which has a third; one column is empty."""
    return spark.range(200_000).select(
        F.expr("date_add(DATE '2023-01-01', if(id % 3 = 0, 7, int(id % 40)))").alias("day"),
        F.col("id").alias("rental"),
        F.expr("int(pmod(hash(id), 5000))").alias("bike"),
        F.expr("if(id % 10 = 0, NULL, concat('station ', pmod(hash(id, 1), 800)))").alias("station"),
        F.expr("timestamp_seconds(pmod(hash(id, 2), 90000))").alias("at"),
        F.expr("if(id % 2 = 0, double('-0.0'), double(id % 7))").alias("share"),
        F.expr("CAST(NULL AS int)").alias("nothing"),
    )


def test_merged_estimates_are_within_the_bound(spark, hires):
    sketches = partition_sketches(hires, "day")
    found, truth = estimates(sketches), exact(hires, "day")
    assert set(found) == set(truth)
    for name, n in truth.items():
        assert abs(found[name] - n) <= n * error_bound(), name
    assert found["nothing"] == 0 and found["share"] == truth["share"] == 7
    present = {r.column_name: r.present for r in merged_profile(sketches).collect()}
    assert present == {r.column_name: r.present for r in hires.drop("day").agg(
        *[F.count(c).alias(c) for c in hires.columns if c != "day"]).unpivot([], hires.columns[1:], "column_name", "present").collect()}


def test_a_range_of_partitions_is_merged_without_the_rest(spark, hires):
    week = hires.where("day < DATE '2023-01-08'")
    found = estimates(partition_sketches(hires, "day").where("partition_value < '2023-01-08'"))
    for name, n in exact(week, "day").items():
        assert abs(found[name] - n) <= n * error_bound(), name


def test_sketches_travel_in_place_of_values(hires):
    plan = partition_sketches(hires, "day")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_hll_sketch_agg" in plan
    assert "Python" not in plan


def test_refresh_reads_new_and_changed_partitions_only(spark, hires, tmp_path):
    root, store = str(tmp_path / "hires"), str(tmp_path / "profile")
    early = hires.where("day < DATE '2023-02-01'")
    early.write.partitionBy("day").parquet(root)
    schema = spark.read.parquet(root).schema
    assert schema["day"].dataType == T.DateType()
    first, read = refresh_sketches(spark, root, schema, "day", store)
    assert read == 31 and first.schema.simpleString() == spark.createDataFrame([], STORED).schema.simpleString()
    assert refresh_sketches(spark, root, schema, "day", store)[1] == 0  # nothing new
    hires.where("day >= DATE '2023-02-01'").write.mode("append").partitionBy("day").parquet(root)
    # One more file in a known day.
    hires.where("day = DATE '2023-01-03'").withColumn("bike", F.lit(9_999_999)).write.mode("append").partitionBy("day").parquet(root)
    present = hires.unionByName(hires.where("day = DATE '2023-01-03'").withColumn("bike", F.lit(9_999_999)))
    sketches, read = refresh_sketches(spark, root, schema, "day", store)
    assert read == 9 + 1
    assert sketches.count() == 40 * 6
    found = estimates(sketches)
    for name, n in exact(present, "day").items():
        assert abs(found[name] - n) <= n * error_bound(), name
    once = {r.column_name: r.distinct_estimate for r in merged_profile(partition_sketches(present, "day")).collect()}
    assert found == pytest.approx(once, rel=error_bound())


def test_the_scan_of_a_refresh_is_pruned_to_stale_partitions(spark, hires, tmp_path):
    """Days that did not change hold files that no reader could read; the refresh does not touch them."""
    root, store = str(tmp_path / "hires"), str(tmp_path / "profile")
    hires.write.partitionBy("day").parquet(root)
    schema = spark.read.parquet(root).schema
    refresh_sketches(spark, root, schema, "day", store)
    broken = next((tmp_path / "hires" / "day=2023-01-05").glob("*.parquet"))
    times = broken.stat()
    broken.write_bytes(b"x" * times.st_size)
    os.utime(broken, ns=(times.st_atime_ns, times.st_mtime_ns))
    (tmp_path / "hires" / "day=2023-01-05" / f".{broken.name}.crc").unlink(missing_ok=True)
    hires.where("day = DATE '2023-01-06'").write.mode("append").partitionBy("day").parquet(root)
    sketches, read = refresh_sketches(spark, root, schema, "day", store)
    assert read == 1 and sketches.count() == 40 * 6


def test_null_partition_dropped_partition_and_new_column(spark, tmp_path):
    store = str(tmp_path / "profile")
    root = str(tmp_path / "t")
    rows_in = [(dt.date(2023, 1, 1), 1), (dt.date(2023, 1, 2), 2), (dt.date(2023, 1, 2), None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows_in, "day date, `a b` int")
    publish(spark, root, lambda to: df.write.partitionBy("day").parquet(to))
    sketches, read = refresh_sketches(spark, root, df.schema, "day", store)
    assert read == 3 and rows(sketches.select("partition_value", "column_name", "present")) == rows(
        spark.createDataFrame([("2023-01-01", "a b", 1), ("2023-01-02", "a b", 1), (None, "a b", 2)], "p string, c string, n long")
    )
    assert estimates(sketches) == {"a b": 4}
    wider = df.where("day IS NULL OR day > DATE '2023-01-01'").withColumn("extra", F.lit("x"))
    publish(spark, root, lambda to: wider.write.partitionBy("day").parquet(to))
    sketches, read = refresh_sketches(spark, root, wider.schema, "day", store)
    assert read == 2 and estimates(sketches) == {"a b": 3, "extra": 1}
    assert refresh_sketches(spark, root, wider.schema, "day", store)[1] == 0
    # Sketches of another size replace all of them.
    assert refresh_sketches(spark, root, wider.schema, "day", store, 10)[1] == 2


def test_partitions_named_by_texts_like_numbers_stay_texts(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2)], "p string, v int")
    df.write.partitionBy("p").parquet(str(tmp_path / "t"))
    states = partition_states(spark, str(tmp_path / "t"), df.schema["p"])
    assert sorted(r.partition_value for r in states.collect()) == ["007", "7"]
    sketches, read = refresh_sketches(spark, str(tmp_path / "t"), df.schema, "p", str(tmp_path / "s"))
    assert read == 2 and estimates(sketches) == {"v": 2}


def test_warehouse_profile_follows_the_table(spark, hires, tmp_path):
    built = Warehouse(spark, str(tmp_path))
    facts = hires.select(F.col("day").alias("start_date_key"), F.col("bike").cast("long").alias("bike_id"),
                         F.col("rental").alias("start_station_id"), F.col("rental").alias("end_station_id"))
    for part in (facts.where("bike_id < 100"), facts):
        written = built.save("fact_hire", part)
        found = {r.column_name: r.distinct_estimate for r in built.profile("fact_hire").collect()}
        for name, n in exact(written, "start_date_key").items():
            assert abs(found[name] - n) <= n * error_bound(), name
