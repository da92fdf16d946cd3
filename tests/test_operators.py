"""Operators against brute force."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import statistics

import pytest
from build import rows
from pyspark.sql import functions as F

from velomart.functions import columns as c
from velomart.operators.aggregates import distinct_counts, exact_median, table_profile
from velomart.operators.quality import unique_offenders
from velomart.operators.sorting import head, tail
from velomart.operators.windows import first_per_key


def test_exact_median_equals_sorting(spark):
    draw = random.Random(7)
    groups = {
        "spread": [draw.randrange(-10**7, 10**7) for _ in range(2000)],
        "even": [draw.randrange(0, 5000) for _ in range(801)],
        "one value in most rows": [42] * 900 + [draw.randrange(0, 10**6) for _ in range(450)],
        "two": [10, 2_000_001],
        "single": [-5],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [("spread", None), ("nothing", None)]
    df = spark.createDataFrame(data, "g string, v long").repartition(5)
    for accuracy in (10_000, 20):  # whole range, then brackets
        found = exact_median(df, "g", "v", accuracy)
        middle = {r.g: (r.low + r.high) / 2 for r in found.collect()}
        assert middle == {g: statistics.median(values) for g, values in groups.items()}


def test_exact_median_brackets_a_large_group(spark):
    """Half a million values, in order and shuffled, with one value that holds a third of the rows."""
    df = spark.range(500_000).selectExpr("id % 2 AS g", "if(id % 3 = 0, 77, pmod(id * 7919, 1000003)) AS v")
    expected = df.groupBy("g").agg(F.expr("percentile(v, 0.5) AS m")).collect()
    for order in ("v", "hash(v)"):
        found = exact_median(df.orderBy(F.expr(order)), "g", "v", 1000).collect()
        assert {r.g: (r.low + r.high) / 2 for r in found} == {r.g: r.m for r in expected}


def test_unique_offenders_with_colliding_fingerprints(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,), (None,), ("e",)], "k string")
    same = lambda column: F.when(F.col(column) == "e", 1).otherwise(0)
    assert rows(unique_offenders(df, "k", same)) == rows(unique_offenders(df, "k")) == [("b", 2)]
    numbers = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert rows(unique_offenders(numbers, "k")) == [(1, 2)]
    shuffled = unique_offenders(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "fingerprint" in shuffled

def test_first_per_key_takes_one_row_per_key_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, None, "c"), (2, None, "d")], "k int, v int, x string")
    best = first_per_key(df, ["k"], [F.desc_nulls_last("v")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one before the exchange, one after
    assert rows(best) == [(1, 9, "b"), (2, None, "d")]


def test_head_and_tail(spark):
    df = spark.range(20).selectExpr("19 - id AS v").repartition(4)
    assert [r.v for r in head(df, "v", 3).collect()] == [0, 1, 2]
    assert [r.v for r in tail(df, "v", 3).collect()] == [17, 18, 19]


def test_distinct_counts_ignore_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, `y z` string")
    assert rows(distinct_counts(df)) == [("x", 2), ("y z", 2)]
    assert rows(table_profile({"t": df, "u": df.limit(1)})) == [("t", "x", 2), ("t", "y z", 2), ("u", "x", 1), ("u", "y z", 1)]


def test_surrogate_key_marks_nulls(spark):
    token = "_dbt_utils_surrogate_key_null_"
    df = spark.createDataFrame([(1, "a"), (None, ""), (None, None)], "i int, s string")
    keys = [r[0] for r in df.select(c.surrogate_key("i", "s")).collect()]
    assert keys == [hashlib.md5(t.encode()).hexdigest() for t in ("1-a", f"{token}-", f"{token}-{token}")]


@pytest.mark.parametrize("zone", ["UTC", "Europe/London", "America/New_York"])
def test_time_arithmetic_does_not_depend_on_the_session_zone(spark, zone):
    begin, end = dt.datetime(2022, 1, 3, 1, 2, 3, 4), dt.datetime(2022, 10, 30, 1, 30, 59, 999999)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(begin, end)], "a timestamp_ntz, b timestamp_ntz")
        forth, back = df.select(c.micros_between("a", "b"), c.micros_between("b", "a")).first()
        micros = (end - begin) // dt.timedelta(microseconds=1)
        assert (forth, back) == (micros, -micros)
        instant = spark.sql("SELECT TIMESTAMP'2022-07-01 12:00:00.000001 UTC' AS t")
        assert instant.select(c.utc_ntz("t")).first()[0] == dt.datetime(2022, 7, 1, 12, 0, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lenient_cast_and_default_sum(spark):
    df = spark.createDataFrame([("7", None, 2), ("x", None, None)], "t string, a int, b int")
    assert rows(df.select(c.lenient_int("t").alias("t"), c.zero_if_missing("a", "b").alias("s"))) == [(7, 2), (None, 0)]
