from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import START, column
from pyspark.sql import functions as F

from panelwright.operators import segments, signals


def test_momentum_skips_the_latest_row(series):
    out = signals.momentum(series({"A": [100, 102, 104, 106, 108, 500]}), windows={"m": 3})
    assert column(out, "m")[5] == pytest.approx(108 / 102 - 1)


def test_momentum_compounds(series):
    out = signals.momentum(series({"A": [100, 110, 121, 133.1, 146.41]}), windows={"m": 1})
    assert column(out, "m")[2:] == [pytest.approx(0.10)] * 3 and column(out, "m")[:2] == [None, None]


def test_z_is_taken_per_day(spark):
    from conftest import days

    d1, d2 = days(2)
    rows = [("A", d1, 0.1), ("B", d1, 0.2), ("C", d1, 0.3), ("A", d2, 0.05), ("B", d2, 0.05), ("C", d2, 0.05)]
    out = signals.cross_section_z(spark.createDataFrame(rows, "ticker string, date date, m double"), ["m"])
    z = column(out, "m_z", "date", "ticker")
    assert z[:3] == [pytest.approx(-1), pytest.approx(0, abs=1e-9), pytest.approx(1)]
    assert z[3:] == [None, None, None]


def test_z_ignores_missing_values(spark):
    rows = [("A", START, 1.0), ("B", START, 3.0), ("C", START, None)]
    out = signals.cross_section_z(spark.createDataFrame(rows, "ticker string, date date, m double"), ["m"])
    s = math.sqrt(2)
    assert column(out, "m_z", "ticker") == [pytest.approx(-1 / s), pytest.approx(1 / s), None]


def rsi_by_loop(closes: list, rows: int = 14) -> list:
    """Direct weighted sums over all earlier changes."""
    out = []
    for k in range(len(closes)):
        up = down = 0.0
        known = 0
        for j in range(1, k + 1):
            if closes[j] is None or closes[j - 1] is None:
                continue
            change, weight = closes[j] - closes[j - 1], (1 - 1 / rows) ** (k - j)
            known += 1
            up, down = up + max(change, 0) * weight, down + max(-change, 0) * weight
        if known < rows or up == down == 0:
            out.append(None)
        else:
            out.append(100.0 if down == 0 else 0.0 if up == 0 else 100 - 100 / (1 + up / down))
    return out


@pytest.mark.parametrize(
    ("closes", "last"),
    [([100 + k for k in range(30)], 100.0), ([100 - k for k in range(30)], 0.0), ([100] * 30, None), ([1, 2, 3], None)],
)
def test_rsi_edges(series, closes, last):
    assert column(signals.rsi(series({"A": closes})), "rsi_14")[-1] == last


def test_rsi_needs_fourteen_changes(series):
    out = column(signals.rsi(series({"A": [100 + (k % 3) for k in range(20)]})), "rsi_14")
    assert out[:14] == [None] * 14 and out[14] is not None


def test_rsi_matches_direct_sums_over_gaps_and_series(series):
    rng = random.Random(3)
    a = [rng.uniform(50, 150) if rng.random() > 0.1 else None for _ in range(80)]
    b = [rng.uniform(50, 150) for _ in range(40)]
    out = column(signals.rsi(series({"A": a, "B": b})), "rsi_14", "ticker", "date")
    assert out == pytest.approx(rsi_by_loop(a) + rsi_by_loop(b), abs=1e-9)
    assert all(0 <= v <= 100 for v in out if v is not None)


def test_rsi_over_several_blocks_matches_pandas(series):
    rng = np.random.default_rng(5)
    closes = pd.Series(100 + rng.normal(size=3000).cumsum() * 0.1)
    closes.iloc[1500:2700] = closes.iloc[1500]  # longer than a block without any move
    change = closes.diff()
    up = change.clip(lower=0).ewm(com=13, min_periods=14).mean()
    down = (-change.clip(upper=0)).ewm(com=13, min_periods=14).mean()
    expected = 100 - 100 / (1 + up / down)
    out = pd.Series(column(signals.rsi(series({"A": closes.tolist()})), "rsi_14"), dtype=float)
    assert (out.isna() == expected.isna()).all()
    assert (out - expected).abs().max() < 1e-6


def test_price_z(series):
    closes = [float((k * 13) % 17) for k in range(40)]
    out = column(signals.price_z(series({"A": closes})), "price_z_20d")
    assert out[:9] == [None] * 9 and out[9] is not None
    window = closes[20:]
    assert out[-1] == pytest.approx((closes[-1] - statistics.mean(window)) / statistics.stdev(window))


def test_price_z_of_a_flat_series_is_null(series):
    assert set(column(signals.price_z(series({"A": [0.1] * 25})), "price_z_20d")) == {None}


def test_moving_averages(series):
    closes = [float(k % 23) for k in range(450)]
    out = signals.moving_averages(series({"A": closes}))
    fast, slow, ratio = (column(out, c) for c in ("ma_50", "ma_200", "ma_ratio_50_200"))
    assert fast[28] is None and fast[29] is not None and slow[98] is None and slow[99] is not None
    for k in (99, 198, 199, 200, 399, 400, 449):
        assert slow[k] == pytest.approx(statistics.mean(closes[max(0, k - 199) : k + 1]))
    assert ratio[449] == pytest.approx(fast[449] / slow[449])


def test_trend_signal(spark):
    rows = [(1, 110.0, 100.0), (2, 90.0, 100.0), (3, 100.0, 100.0), (4, None, 100.0), (5, 1.0, None)]
    out = signals.trend_signal(spark.createDataFrame(rows, "k int, ma_50 double, ma_200 double"))
    assert column(out, "trend_signal", "k") == [1, -1, 0, 0, 0]


def test_momentum_score_counts_missing_as_zero(spark):
    rows = [(1, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0), (3, None, None, None)]
    out = signals.momentum_score(spark.createDataFrame(rows, "k int, mom_1m_z double, mom_3m_z double, mom_6m_z double"))
    assert column(out, "momentum_score", "k") == pytest.approx([1.0, 0.8, 0.0])


def test_compute_signals_columns(series):
    out = signals.compute_signals(series({"A": list(range(1, 31)), "B": list(range(40, 10, -1))}))
    assert len(out.columns) == 3 + 15 and out.count() == 60


def test_segments_give_the_same_result_as_whole_series(spark):
    rng = random.Random(11)
    rows = [("hot" if k % 3 else "cold", k, rng.random() * 100) for k in range(900)]
    df = spark.createDataFrame(rows, "ticker string, seq int, close double")

    def step(frame, keys):
        return signals.moving_averages(frame.withColumn("date", F.col(segments.POSITION)), keys)

    cut = segments.in_segments(df, step, ["ticker"], ["seq"], back=199, rows_per_segment=70)
    whole = signals.moving_averages(df.withColumn("date", F.col("seq")))
    a, b = (x.orderBy("seq").select("seq", "ma_50", "ma_200").collect() for x in (cut, whole))
    assert [r["seq"] for r in a] == list(range(900))
    for name in ("ma_50", "ma_200"):
        assert [r[name] for r in a] == pytest.approx([r[name] for r in b])


def test_positions_follow_the_order_within_each_key(spark):
    df = spark.createDataFrame([("A", k) for k in (5, 1, 9, 30, 12)] + [("B", 7), (None, 3)], "key string, seq int")
    out = segments.with_positions(df, ["key"], ["seq"])
    assert [tuple(r) for r in out.select("key", "seq", segments.POSITION).orderBy("key", "seq").collect()] == [
        (None, 3, 0), ("A", 1, 0), ("A", 5, 1), ("A", 9, 2), ("A", 12, 3), ("A", 30, 4), ("B", 7, 0),
    ]


def test_excluded_series_are_scored_but_not_counted(spark):
    rows = [("A", START, 1.0), ("B", START, 3.0), ("^I", START, 99.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, m double")
    z = column(signals.cross_section_z(df, ["m"], exclude=["^I"]), "m_z", "ticker")
    assert z[:2] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)]) and z[2] == pytest.approx(97 / math.sqrt(2))


def test_momentum_over_a_gap(series):
    panel = series({"A": [100, None, 121, 130]})
    assert column(signals.momentum(panel, windows={"m": 1}), "m") == [None] * 4
    padded = column(signals.momentum(panel, windows={"m": 1}, pad=True), "m")
    assert padded == [None, None, 0.0, pytest.approx(0.21)]


@pytest.mark.parametrize("rows", [1, 2, 14, 100, 200, 500])
def test_rsi_of_any_length_equals_a_plain_loop(series, rows):
    """Over many blocks, with a long standstill that leaves whole blocks without a move."""
    closes = [100 + 7 * math.sin(k * 0.7) + (k * 37 % 11) * 0.3 for k in range(4000)]
    closes += [closes[-1]] * 900 + [closes[-1] + 1 + math.cos(k) for k in range(1100)]
    out = column(signals.rsi(series({"A": closes}), rows=rows, column="x"), "x")
    decay, up, down = (rows - 1) / rows, 0.0, 0.0
    for k in range(1, len(closes)):
        change = closes[k] - closes[k - 1]
        up, down = up * decay + max(change, 0), down * decay + max(-change, 0)
        if k < rows:
            assert out[k] is None
        elif up + down > 1e-280:
            assert out[k] == pytest.approx(100 - 100 / (1 + up / down) if down else 100.0, abs=1e-7)
