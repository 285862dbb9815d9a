from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import business_days, column, months
from pyspark.sql import functions as F
from test_predictor import FEATURES, matrix_of, newton

from panelwright.operators import backtest, predictor, walkforward
from panelwright.operators import newton as fits

INDEX = "^I"


@pytest.fixture(scope="module")
def master(spark):
    """30 x 21 business days, 6 series and an index, random walks with random features."""
    rng = np.random.default_rng(1)
    dates = business_days(630)
    frames = []
    for ticker in [*"ABCDEF", INDEX]:
        frames.append(
            pd.DataFrame(
                {
                    "ticker": ticker,
                    "date": dates,
                    "close": 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, len(dates)))),
                    "momentum_score": rng.normal(size=len(dates)),
                    "rsi_14": rng.uniform(20, 80, len(dates)),
                    "trend_signal": rng.integers(-1, 2, len(dates)),
                    "composite_regime": ["R1" if k % 120 < 70 else "R2" if k < 500 else "R3" for k in range(len(dates))],
                }
            )
        )
    raw = spark.createDataFrame(
        pd.concat(frames),
        "ticker string, date date, close double, momentum_score double, rsi_14 double, trend_signal int, composite_regime string",
    )
    return predictor.outperformance_label(raw, INDEX).cache()


@pytest.fixture(scope="module")
def results(master):
    return walkforward.walk_forward(master, top_n=3, index_ticker=INDEX).cache()


def test_rebalance_dates_skip_the_first_year(master):
    dates = column(backtest.rebalance_dates(master), "rebalance_date", "rebalance_date")
    assert 15 <= len(dates) <= 19 and dates[0] == date(2021, 1, 1)
    firsts = {d: min(x for x in business_days(630) if (x.year, x.month) == (d.year, d.month)) for d in dates}
    assert all(d == first for d, first in firsts.items())


def test_short_history_has_no_dates_and_no_results(spark, master):
    short = master.where(F.col("date") < F.lit(date(2020, 6, 1)))
    assert backtest.rebalance_dates(short).count() == 0
    out = walkforward.walk_forward(short, top_n=3, index_ticker=INDEX)
    assert out.count() == 0 and out.columns == list(backtest.RESULT_COLUMNS)


def test_embargo_moves_the_cutoff_back(master):
    row = backtest.rebalance_dates(master, embargo_rows=5).orderBy("rebalance_date").first()
    assert row["cutoff"] == business_days(630)[business_days(630).index(row["rebalance_date"]) - 5]


def test_picks_and_costs(results):
    rows = results.collect()
    assert len(rows) >= 14
    for r in rows:
        assert len(r["picked_tickers"].split(", ")) == 3 and INDEX not in r["picked_tickers"]
        assert r["net_excess_return"] == pytest.approx(r["excess_return"] - 0.0015)
        assert r["excess_return"] == pytest.approx(r["portfolio_return"] - r["alsi_return"])
        assert r["beat_alsi"] == (r["excess_return"] > 0)


def test_every_date_matches_a_separate_fit(master, results):
    pdf = master.toPandas()
    for found in results.collect():
        day = found["rebalance_date"]
        train = pdf[pdf["date"] < day].dropna(subset=[*FEATURES, "composite_regime", "outperformed"])
        x, y = matrix_of(train), train["outperformed"].to_numpy(float)
        intercept, slopes = newton(x, y)
        snapshot = pdf[(pdf["date"] == day) & (pdf["ticker"] != INDEX)].dropna(subset=["fwd_return_21d"]).sort_values("ticker")
        flags = [(snapshot["composite_regime"] == v).astype(float) for v in sorted(train["composite_regime"].unique())]
        z = (np.column_stack([snapshot[list(FEATURES)].to_numpy(float), *flags]) - x.mean(axis=0)) / x.std(axis=0)
        best = snapshot.assign(p=intercept + z @ slopes).nlargest(3, "p")
        assert found["picked_tickers"] == ", ".join(best["ticker"])
        assert found["portfolio_return"] == pytest.approx(best["fwd_return_21d"].mean())


def test_dated_models_match_the_exact_optimum(master):
    models = walkforward.fit_dated_models(master, backtest.rebalance_dates(master))
    pdf = master.toPandas()
    train = pdf[pdf["date"] < models.dates[-1]].dropna(subset=[*FEATURES, "composite_regime", "outperformed"])
    _, slopes = newton(matrix_of(train), train["outperformed"].to_numpy(float))
    assert models.coefficients[-1] == pytest.approx(slopes, abs=1e-6)


def test_one_class_history_gives_no_results(master):
    flat = master.withColumn("outperformed", F.lit(0))
    assert walkforward.walk_forward(flat, top_n=3, index_ticker=INDEX).count() == 0


def test_index_rows_can_be_kept_out_of_training(master, results):
    out = walkforward.walk_forward(master, top_n=3, index_ticker=INDEX, exclude_from_training=[INDEX])
    assert out.count() == results.count()


def test_dates_with_too_few_series_are_left_out(master):
    assert walkforward.walk_forward(master, top_n=7, index_ticker=INDEX).count() == 0


def test_top_picks_break_ties_by_ticker(spark):
    day = date(2024, 1, 1)
    rows = [(t, day, s, 0.1, 0.0) for t, s in (("C", 1.0), ("B", 1.0), ("A", 0.5), ("D", None), (INDEX, 9.0))]
    df = spark.createDataFrame(rows, "ticker string, date date, s double, fwd_return_21d double, alsi_fwd_return_21d double")
    assert column(backtest.top_picks(df, "s", 2, INDEX), "ticker", "pick_rank") == ["B", "C"]
    assert backtest.top_picks(df, "s", 4, INDEX).count() == 0


@pytest.fixture
def periods(spark):
    def build(excess):
        rows = [(d, float(e), float(e) - 0.0015, e > 0) for d, e in zip(months(len(excess)), excess)]
        return spark.createDataFrame(
            rows, "rebalance_date date, excess_return double, net_excess_return double, beat_alsi boolean"
        )

    return build


def test_summary(periods):
    excess = [0.02, -0.01, 0.03, -0.02]
    out = backtest.backtest_summary(periods(excess)).first()
    net = [e - 0.0015 for e in excess]
    assert out["n_periods"] == 4 and out["hit_rate"] == 0.5 and out["avg_excess_return_gross"] == 0.005
    assert out["sharpe_style_ratio"] == pytest.approx(round(np.mean(net) / np.std(net, ddof=1) * math.sqrt(12), 2))
    assert "thin sample" in out["note"]


def test_summary_of_nothing_and_of_equal_returns(periods):
    empty = backtest.backtest_summary(periods([])).first()
    assert empty["n_periods"] == 0 and empty["hit_rate"] is None
    assert backtest.backtest_summary(periods([0.01] * 30)).first()["sharpe_style_ratio"] is None
    assert "thin" not in backtest.backtest_summary(periods([0.01] * 30)).first()["note"]


def test_cumulative_and_rolling(periods):
    df = periods([0.1, -0.5, 0.2, -1.5, 0.1, 0.1, 0.1])
    gross = column(backtest.cumulative_excess(df), "cumulative_gross_excess", "rebalance_date")
    assert gross == pytest.approx(list(np.cumprod(1 + np.array([0.1, -0.5, 0.2, -1.5, 0.1, 0.1, 0.1])) - 1))
    rate = column(backtest.rolling_hit_rate(df), "rolling_hit_rate_12m", "rebalance_date")
    assert rate[:5] == [None] * 5 and rate[5:] == pytest.approx([4 / 6, 5 / 7])


def test_unconverged_dates_are_flagged(spark, master):
    dates = backtest.rebalance_dates(master)
    full = walkforward.fit_dated_models(master, dates)
    table = full.fit_table(spark).collect()
    assert all(r["converged"] and r["gradient_norm"] <= 1e-10 * r["train_rows"] for r in table)
    # Dates that start from a neighbour's optimum need fewer passes than those that start from zero.
    passes = [r["iterations"] for r in sorted(table, key=lambda r: r["rebalance_date"])]
    cold, warm = passes[::fits.STRIDE], [p for k, p in enumerate(passes) if k % fits.STRIDE]
    assert max(warm) <= max(cold) and sum(warm) / len(warm) < sum(cold) / len(cold)
    short = walkforward.fit_dated_models(master, dates, max_iterations=2)
    assert not all(r["converged"] for r in short.fit_table(spark).collect())
    flagged = walkforward.walk_forward(master, top_n=3, index_ticker=INDEX, max_iterations=2, with_status=True)
    assert flagged.columns[-1] == "converged" and not all(column(flagged, "converged", "rebalance_date"))


def test_start_does_not_change_the_optimum(master):
    dates = backtest.rebalance_dates(master)
    warm = walkforward.fit_dated_models(master, dates)
    stride, fits.STRIDE = fits.STRIDE, 1
    try:
        cold = walkforward.fit_dated_models(master, dates)
    finally:
        fits.STRIDE = stride
    assert warm.coefficients == pytest.approx(cold.coefficients, abs=1e-7)


def test_distribution_and_histogram(periods):
    df = periods([k / 100 for k in range(61)])
    out = backtest.return_distribution(df, "excess_return").first()
    assert out["count"] == 61 and out["p50"] == pytest.approx(0.30) and out["p25"] == pytest.approx(0.15)
    bins = backtest.return_histogram(df, "excess_return")
    assert sum(column(bins, "n", "bin")) == 61 and column(bins, "bin", "bin")[-1] == 30
    assert [tuple(r) for r in backtest.return_histogram(periods([0.1] * 4), "excess_return").collect()] == [(1, 0.1, 0.1, 4)]
    assert backtest.return_histogram(periods([]), "excess_return").count() == 0
