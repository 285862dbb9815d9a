from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import column, days
from pyspark.sql import functions as F

from panelwright.functions.guarded import pearson
from panelwright.operators import correlation


@pytest.fixture
def panel(spark):
    def build(returns, macro, ticker="A"):
        rows = [
            (d, ticker, None if r is None else float(r), None if m is None else float(m))
            for d, r, m in zip(days(len(returns)), returns, macro)
        ]
        return spark.createDataFrame(rows, "date date, ticker string, daily_return double, tbill_rate double")

    return build


RNG = np.random.default_rng(7)


def test_proportional_series(panel):
    x = RNG.normal(size=100)
    out = correlation.rolling_correlations(panel(x, 2 * x + 1))
    assert out.count() == 71 and column(out, "rolling_corr") == pytest.approx([1.0] * 71)
    opposite = correlation.rolling_correlations(panel(x, -x))
    assert column(opposite, "rolling_corr") == pytest.approx([-1.0] * 71)


def test_first_value_is_on_the_thirtieth_row(panel):
    x = RNG.normal(size=60)
    out = correlation.rolling_correlations(panel(x, x))
    assert column(out, "date")[0] == days(60)[29]


def test_no_look_ahead(panel):
    x = RNG.normal(size=100)
    out = correlation.rolling_correlations(panel(x, np.concatenate([x[:50], -x[50:]])))
    values = dict(zip(column(out, "date"), column(out, "rolling_corr")))
    assert values[days(50)[49]] > 0.9 and values[days(100)[99]] < 0.9


def test_matches_pandas_with_gaps(panel):
    x, y = RNG.normal(size=400), 1e6 + RNG.normal(size=400).cumsum()
    x[RNG.random(400) < 0.1] = np.nan
    y[150:200] = np.nan
    expected = pd.Series(x).rolling(90, min_periods=30).corr(pd.Series(y))
    null = lambda v: [None if np.isnan(k) else k for k in v]
    out = correlation.rolling_correlations(panel(null(x), null(y)))
    found = pd.Series(dict(zip(column(out, "date"), column(out, "rolling_corr"))))
    expected.index = days(400)
    pd.testing.assert_series_equal(found, expected.dropna(), check_names=False, rtol=1e-7, check_dtype=False)
    assert found.between(-1, 1).all()


def test_constant_side_gives_no_rows(panel):
    assert correlation.rolling_correlations(panel(RNG.normal(size=60), [3.3] * 60)).count() == 0
    assert correlation.rolling_correlations(panel(RNG.normal(size=400), [358907.5514399999] * 400)).count() == 0


def test_name_falls_back_to_the_key_and_absent_variables_are_skipped(panel):
    x = RNG.normal(size=31)
    out = correlation.rolling_correlations(panel(x, x))
    assert {(r["name"], r["macro_var"]) for r in out.collect()} == {("A", "tbill_rate")}


def test_summary(spark):
    rows = [("A", "x", v) for v in (0.1, 0.2, 0.4)]
    out = correlation.rolling_correlation_summary(
        spark.createDataFrame(rows, "ticker string, macro_var string, rolling_corr double")
    ).first()
    assert tuple(out) == ("A", "x", 0.2333, 0.1528, 0.1, 0.4)


@pytest.mark.parametrize("block", [2, 256])
def test_matrix_matches_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(correlation, "SERIES_PER_BLOCK", block)
    names = [f"T{k}" for k in range(7)]
    wide = pd.DataFrame(RNG.normal(size=(500, 7)), columns=names, index=pd.to_datetime(days(500)))
    wide = wide.mask(RNG.random(wide.shape) < 0.2)
    wide["T6"] = 0.25
    long = wide.stack().rename("daily_return").rename_axis(["date", "ticker"]).reset_index()
    long["date"] = long["date"].dt.date
    df = spark.createDataFrame(long, "date date, ticker string, daily_return double")
    # A repeated reading is averaged with the first.
    df = df.unionByName(df.where("ticker = 'T1'").limit(1))
    out = correlation.correlation_matrix(df).toPandas().pivot(index="ticker_1", columns="ticker_2", values="correlation")
    assert np.nanmax(np.abs(out.astype(float).to_numpy() - wide.corr().to_numpy())) < 1e-12
    assert out["T6"].isna().all() and out.loc["T0", "T0"] == pytest.approx(1.0)


def test_pearson_aggregate(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = df.groupBy("k").agg(pearson(F.col("x"), F.col("y")).alias("c"))
    assert column(out, "c", "k") == [pytest.approx(1.0), None]
