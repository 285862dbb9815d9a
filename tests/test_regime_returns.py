from __future__ import annotations

import pytest
from conftest import column, days

from panelwright.operators import regime_returns

HH, CL, NT = "HIKING_HIGH_INFLATION", "CUTTING_LOW_INFLATION", "NEUTRAL_TARGET_INFLATION"


@pytest.fixture
def panel(spark):
    def build(rows):
        """rows: (ticker, regime, forward return, momentum score)."""
        dated = [(t, d, g, r, None if m is None else float(m)) for d, (t, g, r, m) in zip(days(len(rows)), rows)]
        return spark.createDataFrame(
            dated, "ticker string, date date, composite_regime string, fwd_return_21d double, momentum_score double"
        )

    return build


def test_forward_return(series):
    out = regime_returns.forward_return(series({"A": [100, 110, 121, 0]}), rows=2)
    assert column(out, "fwd_return_21d") == [pytest.approx(0.21), -1.0, None, None]


def test_small_cells_are_blank(panel):
    df = panel([("A", HH, 0.02, 1.0)] * 20 + [("A", CL, 0.5, 1.0)] * 19 + [("A", HH, None, 1.0), ("A", None, 0.1, 1.0)])
    out = {r["composite_regime"]: r for r in regime_returns.ticker_regime_returns(df).collect()}
    assert out[HH]["avg_fwd_return_pct"] == pytest.approx(2.0) and out[HH]["observations"] == 20
    assert out[CL]["avg_fwd_return_pct"] is None and out[CL]["observations"] == 19


def test_heatmap_order_and_mean(panel):
    rows = [("A", HH, 0.01, 0)] * 20 + [("A", CL, 0.03, 0)] * 20 + [("B", HH, 0.05, 0)] * 20
    out = regime_returns.regime_heatmap(regime_returns.ticker_regime_returns(panel(rows))).collect()
    assert [r["ticker"] for r in out] == ["B", "A"]
    assert out[1]["mean_across_regimes"] == pytest.approx(2.0) and out[0][CL] is None


def test_regimes_with_one_spell_are_blanked(spark, panel):
    from conftest import months

    table = spark.createDataFrame(list(zip(months(4), [HH, CL, CL, HH])), "date date, composite_regime string")
    df = panel([("A", HH, 0.02, 1.0)] * 20 + [("A", CL, 0.5, 1.0)] * 20)
    out = {r["composite_regime"]: r for r in regime_returns.reliable_cells(df, table).collect()}
    assert out[HH]["avg_fwd_return_pct"] == pytest.approx(2.0) and out[HH]["num_spells"] == 2
    assert out[CL]["avg_fwd_return_pct"] is None and not out[CL]["enough_spells"]


def test_momentum_efficacy(panel):
    rows = [("A", HH, k / 10, float(k)) for k in range(5)] + [("A", CL, -k / 10, float(k)) for k in range(5)]
    rows += [("A", NT, k / 10, float(k)) for k in range(5)] + [("A", HH, 9.0, None)]
    out = {r["composite_regime"]: r["correlation"] for r in regime_returns.momentum_efficacy(panel(rows)).collect()}
    assert out == {HH: pytest.approx(1.0), CL: pytest.approx(-1.0)}


def test_hedges(panel):
    rows = [("A", HH, 0.02, 0), ("A", CL, 0.03, 0), ("B", HH, 0.05, 0), ("B", CL, -0.01, 0), ("C", HH, 0.01, 0)]
    out = regime_returns.regime_hedges(panel(rows)).collect()
    assert [r["ticker"] for r in out] == ["A", "B"]
    assert out[0]["gap"] == pytest.approx(1.0) and out[0]["both_positive"] and not out[1]["both_positive"]
    assert [r["ticker"] for r in regime_returns.best_hedges(regime_returns.regime_hedges(panel(rows))).collect()] == ["A"]


def test_hedges_require_every_stance_that_occurs(panel):
    rows = [("A", HH, 0.02, 0), ("A", CL, 0.03, 0), ("A", NT, 0.0, 0), ("B", HH, 0.05, 0), ("B", CL, 0.01, 0)]
    assert column(regime_returns.regime_hedges(panel(rows)), "ticker", "ticker") == ["A"]


def test_ranking_uses_the_regime_of_the_last_day(panel):
    rows = [("B", CL, 0.9, 0)] * 10 + [("B", HH, 0.01, 0)] * 10 + [("A", HH, 0.05, 0)] * 9 + [("A", HH, -0.01, 0)]
    out = regime_returns.current_regime_ranking(panel(rows)).collect()
    assert [r["ticker"] for r in out] == ["A", "B"]
    assert out[0]["win_rate_pct"] == pytest.approx(90.0) and out[0]["observations"] == 10


def test_ranking_drops_small_samples(panel):
    assert regime_returns.current_regime_ranking(panel([("A", HH, 0.1, 0)] * 9)).count() == 0
