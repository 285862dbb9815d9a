from __future__ import annotations

import math
import statistics

import pytest
from conftest import START, column, days
from pyspark.sql import functions as F

from panelwright.operators import equity, fill, rolling


def test_gap_is_filled(series):
    out = fill.capped_ffill(series({"A": [100, None, None, None, 104]}), ["close"], 5)
    assert column(out, "close") == [100, 100, 100, 100, 104]


def test_fill_stops_after_the_cap(series):
    out = fill.capped_ffill(series({"A": [100] + [None] * 7 + [110]}), ["close"], 5)
    assert column(out, "close") == [100] * 6 + [None, None, 110]


def test_leading_gap_stays(series):
    out = fill.capped_ffill(series({"A": [None, None, 100, 101]}), ["close"], 5)
    assert column(out, "close") == [None, None, 100, 101]


def test_fill_does_not_cross_series(series):
    out = fill.capped_ffill(series({"A": [1, 2], "B": [None, 5]}), ["close"], 5)
    assert column(out, "close", "ticker", "date") == [1, 2, None, 5]


def test_densify_adds_null_rows(spark):
    rows = [("A", START, 1.0, "x"), ("A", days(5)[4], 5.0, "x"), ("B", START, 2.0, "y")]
    out = fill.densify(spark.createDataFrame(rows, "ticker string, date date, close double, name string"))
    assert column(out, "close", "ticker", "date") == [1.0, None, None, None, 5.0, 2.0]
    assert out.columns == ["ticker", "date", "close", "name"]


def test_returns(series):
    out = equity.daily_returns(series({"A": [100, 110, 99]}))
    assert column(out, "daily_return") == [None, pytest.approx(0.10), pytest.approx(-0.10)]
    assert column(out, "log_return")[1] == pytest.approx(math.log(1.1))


def test_returns_do_not_cross_series(series):
    out = equity.daily_returns(series({"A": [100, 110], "B": [10, 20]}))
    assert column(out, "daily_return", "ticker", "date") == [None, pytest.approx(0.1), None, pytest.approx(1.0)]


def test_returns_over_a_gap(series):
    panel = series({"A": [100, None, 110]})
    assert column(equity.daily_returns(panel), "daily_return") == [None, None, None]
    assert column(equity.daily_returns(panel, pad=True), "daily_return") == [None, 0.0, pytest.approx(0.1)]


def test_zero_price_gives_null(series):
    out = equity.daily_returns(series({"A": [0, 5, 0]}))
    assert column(out, "daily_return") == [None, None, -1.0]
    assert column(out, "log_return") == [None, None, None]


def test_volatility_needs_ten_returns_and_is_annualised(series):
    closes = [100 * (1.01 if k % 2 else 0.99) ** k for k in range(30)]
    out = column(equity.volatility(equity.daily_returns(series({"A": closes}))), "volatility_21d")
    assert out[:10] == [None] * 10 and out[10] is not None
    logs = [math.log(b / a) for a, b in zip(closes, closes[1:])]
    assert out[29] == pytest.approx(statistics.stdev(logs[-21:]) * math.sqrt(252))


def test_year_range(series):
    closes = [float((k * 37) % 101 + 1) for k in range(600)]
    out = equity.year_range(series({"A": closes}))
    high, low, gap = (column(out, c) for c in ("high_52w", "low_52w", "pct_from_52w_high"))
    assert high[:49] == [None] * 49
    for k in (49, 250, 251, 252, 253, 503, 504, 505, 599):
        window = closes[max(0, k - 251) : k + 1]
        assert (high[k], low[k]) == (max(window), min(window))
        assert gap[k] == pytest.approx((closes[k] - max(window)) / max(window))
    assert all(h >= lo for h, lo in zip(high[49:], low[49:]))


def test_distance_is_zero_at_the_peak(series):
    out = column(equity.year_range(series({"A": list(range(1, 61))})), "pct_from_52w_high")
    assert out[-1] == 0.0


def test_window_parts_cover_exactly_the_window(series):
    values = [((k * 7919) % 1000) / 7 for k in range(95)]
    df = rolling.with_window_parts(series({"A": values, "B": values[:4]}), {"s": "sum(close)", "n": "count(close)"}, 10, ["ticker"])
    out = df.selectExpr("ticker", "date", f"{rolling.window_total('s')} AS s", f"{rolling.window_total('n')} AS n")
    a = out.where("ticker = 'A'")
    expected = [sum(values[max(0, k - 9) : k + 1]) for k in range(95)]
    assert column(a, "s") == pytest.approx(expected)
    assert column(a, "n") == [min(10, k + 1) for k in range(95)]
    assert column(out.where("ticker = 'B'"), "n") == [1, 2, 3, 4]


def test_calendar_features(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-06-30",)], "d string").select(F.to_date("d").alias("date"))
    rows = [tuple(r)[1:] for r in equity.calendar_features(df).orderBy("date").collect()]
    assert rows == [(2024, 1, 1, 0), (2024, 6, 2, 6)]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5", "abc"), ("NaN", "7")], "close string, volume string")
    assert [tuple(r) for r in equity.coerce_numeric(df).collect()] == [(1.5, None), (None, 7.0)]


def test_processed_prices_share_one_shuffle(series):
    plan = equity.process_prices(series({"A": [1, 2, 3]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_process_prices_columns(series):
    out = equity.process_prices(series({"A": [100, None, 102]}))
    assert column(out, "close") == [100, 100, 102]
    assert column(out, "daily_return") == [None, 0.0, pytest.approx(0.02)]
    assert {"volatility_21d", "high_52w", "low_52w", "pct_from_52w_high", "quarter"} <= set(out.columns)
