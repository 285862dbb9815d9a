from __future__ import annotations

from datetime import date

import pytest
from conftest import column, months

from panelwright.operators import regimes


def labels(spark, states):
    return spark.createDataFrame(list(zip(months(len(states)), states)), "date date, composite_regime string")


@pytest.mark.parametrize(
    ("rates", "last"), [([5, 6, 7, 8], "HIKING"), ([8, 7, 6, 5], "CUTTING"), ([7, 7, 7, 7], "NEUTRAL")]
)
def test_rate_regime(monthly, rates, last):
    assert column(regimes.rate_regime(monthly({"tbill_rate": rates})), "rate_regime")[-1] == last


def test_rate_regime_of_missing_and_first_values_is_neutral(monthly):
    out = regimes.rate_regime(monthly({"tbill_rate": [5, None, 9]}))
    assert column(out, "rate_regime") == ["NEUTRAL", "NEUTRAL", "HIKING"]


def test_inflation_edges(monthly):
    out = regimes.inflation_regime(monthly({"cpi_yoy_pct": [-1, 3.0, 3.01, 6.0, 6.01, None]}))
    low, target, high = "LOW_INFLATION", "TARGET_INFLATION", "HIGH_INFLATION"
    assert column(out, "inflation_regime") == [low, low, target, target, high, "nan"]


def test_currency_regime(monthly):
    out = regimes.currency_regime(monthly({"zar_usd": [100, 100, 100, 103, 97, 101, None]}))
    weak, strong, stable = "WEAK_RAND", "STRONG_RAND", "STABLE_RAND"
    assert column(out, "currency_regime") == [stable] * 3 + [weak, strong, stable, stable]


def test_absent_columns_are_unknown(monthly):
    out = regimes.classify_regimes(monthly({"x": [1, 2]}))
    assert column(out, "composite_regime") == ["UNKNOWN_UNKNOWN"] * 2
    assert column(out, "currency_regime") == ["UNKNOWN"] * 2
    assert column(out, "regime_duration") == [1, 2]


def test_composite_label_order(monthly):
    out = regimes.classify_regimes(monthly({"tbill_rate": [5, 6, 7], "cpi_yoy_pct": [7, 7, None]}))
    assert column(out, "composite_regime") == ["NEUTRAL_HIGH_INFLATION", "HIKING_HIGH_INFLATION", "HIKING_nan"]


H, C = "HIKING_HIGH_INFLATION", "CUTTING_LOW_INFLATION"


def test_duration_resets(spark):
    out = regimes.spell_positions(labels(spark, [H, H, C, C, C, H]))
    assert column(out, "regime_duration") == [1, 2, 1, 2, 3, 1]
    assert column(out, "regime_changed") == [1, 0, 1, 0, 0, 1]


def test_spells_and_summary(spark):
    table = labels(spark, [H, C, H, C, C, H, C])
    assert regimes.spells(table).count() == 6
    summary = {r["regime"]: tuple(r)[1:] for r in regimes.spell_summary(table).collect()}
    assert summary == {C: (4, 1.3, 3), H: (3, 1.0, 3)}
    first = regimes.spells(table).orderBy("start").first()
    assert first["start"] == first["end"] == date(2020, 1, 31) and first["months"] == 1


def test_months_per_regime_skips_unknown_states(spark):
    out = regimes.months_per_regime(labels(spark, [H, None, H, C]))
    assert {tuple(r) for r in out.collect()} == {(H, 2), (C, 1)}


def test_attach_regimes(spark, series, monthly):
    table = regimes.classify_regimes(monthly({"tbill_rate": [5, 6], "cpi_yoy_pct": [2, 2]}))
    panel = series({"A": [1, 2, 3]}, start=date(2020, 1, 30))
    out = regimes.attach_regimes(panel, table)
    assert column(out, "rate_regime") == [None, "NEUTRAL", "NEUTRAL"] and out.count() == 3


def test_economies_are_separate(spark):
    rows = [(c, d, H) for c in ("X", "Y") for d in months(3)]
    df = spark.createDataFrame(rows, "country string, date date, composite_regime string")
    assert column(regimes.spell_positions(df, by=["country"]), "regime_duration", "country", "date") == [1, 2, 3] * 2
    assert regimes.spells(df, ["country"]).count() == 2
