from __future__ import annotations

from datetime import date

import pytest
from conftest import column
from pyspark.sql import functions as F

from panelwright.operators.asof import annual_readings, asof_backward, build_master, snapshot_asof


def panel(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def rates(spark, rows):
    return spark.createDataFrame(rows, "date date, tbill_rate double")


@pytest.fixture
def week(spark):
    return panel(spark, [("A", date(2024, 1, 15 + k), 100.0 + k) for k in range(5)])


READINGS = [(date(2023, 12, 31), 8.25), (date(2024, 1, 31), 8.25), (date(2024, 2, 29), 8.00)]


def test_latest_prior_reading_and_row_count(spark, week):
    out = asof_backward(week, rates(spark, READINGS))
    assert column(out, "tbill_rate") == [8.25] * 5


def test_never_uses_a_later_reading(spark, week):
    out = asof_backward(week, rates(spark, [(date(2023, 12, 31), 8.25), (date(2024, 1, 17), 1.0)]))
    assert column(out, "tbill_rate") == [8.25, 8.25, 1.0, 1.0, 1.0]


def test_equal_date_matches(spark):
    left = panel(spark, [("A", d, 1.0) for d in (date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1))])
    out = asof_backward(left, rates(spark, [(date(2023, 12, 31), 8.25), (date(2024, 1, 31), 8.0)]))
    assert column(out, "tbill_rate") == [8.25, 8.0, 8.0]


def test_before_first_reading_is_null_and_kept(spark):
    left = panel(spark, [("A", date(2020, 1, 1), 1.0), ("A", date(2024, 1, 15), 2.0)])
    assert column(asof_backward(left, rates(spark, READINGS)), "tbill_rate") == [None, 8.25]


def test_long_after_last_reading(spark):
    left = panel(spark, [("A", date(2031, 5, 5), 1.0)])
    assert column(asof_backward(left, rates(spark, READINGS)), "tbill_rate") == [8.0]


def test_same_value_for_all_series_of_a_day(spark):
    left = panel(spark, [(t, date(2024, 1, k), 1.0) for t in ("AAA", "BBB") for k in (15, 20)])
    out = asof_backward(left, rates(spark, [(date(2024, 1, 1), 8.25), (date(2024, 1, 18), 8.0)]))
    assert column(out, "tbill_rate", "date", "ticker") == [8.25, 8.25, 8.0, 8.0]


def test_takes_the_latest_row_even_if_its_value_is_null(spark, week):
    out = asof_backward(week, rates(spark, [(date(2023, 12, 31), 8.25), (date(2024, 1, 16), None)]))
    assert column(out, "tbill_rate") == [8.25, None, None, None, None]


def test_empty_readings(spark, week):
    assert column(asof_backward(week, rates(spark, [])), "tbill_rate") == [None] * 5


def test_keys_are_matched_separately(spark):
    left = spark.createDataFrame(
        [("X", date(2024, 1, 10)), ("Y", date(2024, 1, 10)), ("Z", date(2024, 1, 10))], "country string, date date"
    )
    right = spark.createDataFrame(
        [("X", date(2024, 1, 1), 1.0), ("X", date(2024, 2, 1), 9.0), ("Y", date(2023, 6, 1), 2.0)],
        "country string, date date, rate double",
    )
    assert column(asof_backward(left, right, by=["country"]), "rate", "country") == [1.0, 2.0, None]


def test_large_side_is_not_shuffled(spark, week):
    plan = asof_backward(week, rates(spark, READINGS))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_annual_readings_start_on_new_year(spark):
    annual = spark.createDataFrame([(2023, 1.5), (2024, 2.5)], "year int, gdp_growth_pct double")
    left = panel(spark, [("A", d, 1.0) for d in (date(2022, 5, 1), date(2023, 12, 31), date(2024, 1, 1))])
    assert column(asof_backward(left, annual_readings(annual)), "gdp_growth_pct") == [None, 1.5, 2.5]
    lagged = asof_backward(left, annual_readings(annual, publication_lag_months=12))
    assert column(lagged, "gdp_growth_pct") == [None, None, 1.5]


def test_master_without_annual_keeps_rows(spark, week):
    master = build_master(week, rates(spark, READINGS))
    assert master.count() == 5 and "gdp_growth_pct" not in master.columns
    annual = spark.createDataFrame([(2023, 1.5)], "year int, gdp_growth_pct double")
    full = build_master(week, rates(spark, READINGS), annual)
    assert column(full, "gdp_growth_pct") == [1.5] * 5 and column(full, "tbill_rate") == [8.25] * 5


def test_master_with_publication_lag(spark):
    left = panel(spark, [("A", date(2024, 2, 15), 1.0), ("A", date(2024, 3, 1), 1.0)])
    lagged = build_master(left, rates(spark, READINGS), publication_lag_months=1)
    assert column(lagged, "tbill_rate") == [8.25, 8.25]
    assert column(build_master(left, rates(spark, READINGS)), "tbill_rate") == [8.25, 8.0]


def test_snapshot_takes_last_known_value_per_column(spark):
    rows = [
        ("A", date(2024, 1, 1), 1.0, 10.0),
        ("A", date(2024, 1, 2), 2.0, None),
        ("A", date(2024, 1, 9), 3.0, 30.0),
        ("B", date(2024, 1, 9), 5.0, 5.0),
    ]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    out = snapshot_asof(df, F.lit("2024-01-05").cast("date")).collect()
    assert [tuple(r) for r in out] == [("A", date(2024, 1, 2), 2.0, 10.0)]
