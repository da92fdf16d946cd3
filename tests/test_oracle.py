"""Every query against its SQL twin, all values, and relations between queries."""

from __future__ import annotations

import pytest
from compare import TESTDATA, both, connect

import __spark_entry__ as contract
from velomart.registry.oracle import all_sql
from velomart.registry.queries import all_queries, short_hires

SF = f"{TESTDATA}/sf0.001"
QUERIES, TWINS = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    columns, mine, other_columns, theirs = both(spark, con, name, SF, QUERIES[name], TWINS[name])
    assert columns == other_columns
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 24


def test_both_hour_counts_agree(spark):
    stored = {r.start_hour: r.total_rides for r in all_queries()["rides_by_hour"](spark, SF).collect()}
    derived = {r.hour: r.total_rides for r in all_queries()["rides_by_hour_ts"](spark, SF).collect()}
    assert stored == derived


def test_daily_usage_totals(spark):
    m = short_hires(spark, SF)
    usage = m.daily_usage.selectExpr("sum(hire_count)", "count(*)").first()
    expected = m.fact_hire.join(m.dim_bike.groupBy("bike_id").count(), "bike_id").selectExpr("sum(count)").first()
    assert usage[0] == expected[0]
    assert usage[1] == m.dim_bike.count() * (m.dim_date.count() - 1)


def test_shares_add_up(spark):
    for name, key, share in [
        ("trend_share", "year_month", "pct_of_month"),
        ("lifecycle_histogram", "status", "pct_of_group"),
    ]:
        for row in all_queries()[name](spark, SF).groupBy(key).sum(share).collect():
            assert row[1] == pytest.approx(100, abs=0.05)
