from __future__ import annotations

from datetime import date

import pytest
from conftest import column, days, months

from panelwright.operators import macro


def test_fx_is_averaged_and_rates_take_the_last(spark):
    january = days(31, date(2024, 1, 1))
    rows = [(d, 15 + 4 * k / 30, 8.25 if k < 20 else None) for k, d in enumerate(january)]
    out = macro.monthly_macro(spark.createDataFrame(rows, "date date, zar_usd double, tbill_rate double")).collect()
    assert len(out) == 1 and out[0]["date"] == date(2024, 1, 31)
    assert out[0]["zar_usd"] == pytest.approx(17.0) and out[0]["tbill_rate"] == 8.25


def test_sparse_month_takes_its_only_reading(spark):
    rows = [(d, 105.3 if d.day == 31 else None) for d in days(31, date(2024, 1, 1))]
    out = macro.monthly_macro(spark.createDataFrame(rows, "date date, cpi_all double"))
    assert column(out, "cpi_all") == [105.3]


def test_empty_months_become_rows_and_the_fill_is_capped(spark):
    rows = [(date(2024, 1, 15), 7.25), (date(2024, 7, 2), 7.5)]
    out = macro.monthly_macro(spark.createDataFrame(rows, "date date, tbill_rate double"))
    assert column(out, "date") == months(7, 2024)
    assert column(out, "tbill_rate") == [7.25] * 4 + [None, None, 7.5]


def test_year_on_year_needs_twelve_months(monthly):
    out = macro.macro_changes(monthly({"cpi_all": [100 + k for k in range(14)]}))
    yoy = column(out, "cpi_yoy_pct")
    assert yoy[:12] == [None] * 12
    assert yoy[12:] == [pytest.approx(12.0), pytest.approx((113 / 101 - 1) * 100)]


def test_changes_and_spreads(monthly):
    data = {"zar_usd": [10, 11] + [11] * 11, "tbill_rate": [8] * 13, "govt_bond_10y": [10] * 13}
    out = macro.macro_changes(monthly({**data, "cpi_all": [100] * 12 + [105]}))
    assert column(out, "zar_usd_mom_pct")[:3] == [None, pytest.approx(10.0), 0.0]
    assert column(out, "real_tbill_rate")[12] == pytest.approx(3.0)
    assert column(out, "real_tbill_rate")[0] is None
    assert set(column(out, "yield_curve_spread")) == {2.0}


def test_inverted_curve_is_negative(monthly):
    out = macro.macro_changes(monthly({"tbill_rate": [9], "govt_bond_10y": [8]}))
    assert column(out, "yield_curve_spread") == [-1.0]


def test_absent_columns_are_tolerated(monthly):
    out = macro.macro_changes(monthly({"tbill_rate": [9, 8]}))
    assert out.columns == ["date", "tbill_rate"]


def test_economies_are_processed_separately(spark):
    rows = [("X", date(2024, 1, 5), 1.0), ("X", date(2024, 3, 5), 3.0), ("Y", date(2024, 2, 5), 9.0)]
    out = macro.process_macro(spark.createDataFrame(rows, "country string, date date, zar_usd double"), by=["country"])
    assert column(out, "zar_usd", "country", "date") == [1.0, 1.0, 3.0, 9.0]
    assert column(out, "zar_usd_mom_pct", "country", "date") == [None, 0.0, pytest.approx(200.0), None]


def test_changes_over_a_long_gap(monthly):
    table = monthly({"zar_usd": [10, None, 11]})
    assert column(macro.macro_changes(table), "zar_usd_mom_pct") == [None] * 3
    assert column(macro.macro_changes(table, pad=True), "zar_usd_mom_pct") == [None, 0.0, pytest.approx(10.0)]
