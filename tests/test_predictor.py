from __future__ import annotations

import numpy as np
import pytest
from conftest import column, days
from pyspark.sql import functions as F

from panelwright.operators import predictor

INDEX = "^I"
FEATURES = ("momentum_score", "rsi_14", "trend_signal")


def label(series, stock, index, rows=10):
    out = predictor.outperformance_label(series({"S": stock, INDEX: index}), INDEX, rows)
    return column(out.where("ticker = 'S'"), "outperformed")


UP, FLAT = list(np.linspace(100, 130, 25)), list(np.linspace(100, 110, 25))


def test_label_of_a_winner_and_a_loser(series):
    assert label(series, UP, FLAT) == [1] * 15 + [None] * 10
    assert label(series, FLAT, UP) == [0] * 15 + [None] * 10


def test_label_is_null_without_enough_future(series):
    assert label(series, [1, 2, 3], [1, 2, 3]) == [None] * 3


def test_label_is_null_without_the_index_day(series):
    assert label(series, UP, FLAT[:12]) == [1, 1] + [None] * 23


def test_index_never_beats_itself(series):
    out = predictor.outperformance_label(series({INDEX: UP}), INDEX, 10)
    assert column(out, "outperformed")[:15] == [0] * 15
    assert {"fwd_return_21d", "alsi_fwd_return_21d"} <= set(out.columns)


def test_split_is_strict_and_complete(series):
    df = series({"A": list(range(200))})
    cutoff = days(200)[91]
    train, test = predictor.chronological_split(df, F.lit(cutoff))
    assert train.agg(F.max("date")).first()[0] < cutoff <= test.agg(F.min("date")).first()[0]
    assert train.count() + test.count() == 200


def frame(spark, n=300, seed=42, regimes=("R1", "R2")):
    rng = np.random.default_rng(seed)
    momentum = rng.normal(size=n)
    rows = [
        ("T", d, float(m), float(r), int(t), regimes[k % len(regimes)], int(m > 0))
        for k, (d, m, r, t) in enumerate(zip(days(n), momentum, rng.uniform(20, 80, n), rng.integers(-1, 2, n)))
    ]
    return spark.createDataFrame(
        rows,
        "ticker string, date date, momentum_score double, rsi_14 double, trend_signal int, composite_regime string, outperformed int",
    )


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[float, np.ndarray]:
    """Exact penalised optimum on standardised columns: intercept and slopes."""
    deviation = x.std(axis=0)
    z = np.column_stack([np.ones(len(y)), (x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1.0)])
    penalty = np.diag([0.0] + [1.0 / c] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return w[0], w[1:]


def matrix_of(pdf):
    flags = [(pdf["composite_regime"] == v).astype(float) for v in sorted(pdf["composite_regime"].unique())]
    return np.column_stack([pdf[list(FEATURES)].to_numpy(float), *flags])


def noisy(spark):
    """Labels that the features explain only in part."""
    return frame(spark).withColumn("outperformed", F.when(F.pmod(F.hash("date"), F.lit(4)) == 0, 1 - F.col("outperformed")).otherwise(F.col("outperformed")))


def test_fit_matches_the_exact_optimum(spark):
    df = noisy(spark)
    model = predictor.fit_model(df)
    pdf = df.toPandas()
    intercept, slopes = newton(matrix_of(pdf), pdf["outperformed"].to_numpy(float))
    assert model.names == (*FEATURES, "regime_R1", "regime_R2")
    assert model.intercept == pytest.approx(intercept, abs=1e-5)
    assert np.array(model.coefficients) == pytest.approx(slopes, abs=1e-5)


def test_separable_signal_is_learned(spark):
    df = frame(spark)
    out = predictor.fit_model(df).predict(df).toPandas()
    gap = out.loc[out["outperformed"] == 1, "predicted_proba"].mean() - out.loc[out["outperformed"] == 0, "predicted_proba"].mean()
    assert gap > 0.2 and out["predicted_proba"].between(0, 1).all()


def test_missing_inputs_give_null(spark):
    model = predictor.fit_model(frame(spark))
    rows = frame(spark, 3).withColumn("rsi_14", F.when(F.col("date") == days(1)[0], None).otherwise(F.col("rsi_14")))
    rows = rows.withColumn("composite_regime", F.when(F.col("date") == days(2)[1], None).otherwise(F.col("composite_regime")))
    out = column(model.predict(rows), "predicted_proba")
    assert out[:2] == [None, None] and out[2] is not None


def test_unseen_regime_has_no_flags(spark):
    model = predictor.fit_model(frame(spark))
    out = model.predict(frame(spark, 5, regimes=("NEW",)))
    assert all(v is not None for v in column(out, "predicted_proba"))
    flags = predictor.feature_matrix(frame(spark, 1, regimes=("NEW",)), model.vocabulary).first()
    assert (flags["regime_R1"], flags["regime_R2"]) == (0.0, 0.0)


def test_incomplete_training_rows_are_ignored(spark):
    df = frame(spark)
    holes = df.limit(5).withColumn("rsi_14", F.lit(None).cast("double"))
    assert predictor.fit_model(df.unionByName(holes)).n_rows == 300


def test_single_class_fails(spark):
    with pytest.raises(ValueError, match="both classes"):
        predictor.fit_model(frame(spark).withColumn("outperformed", F.lit(1)))


def test_coefficients_are_sorted_by_size(spark):
    table = predictor.fit_model(frame(spark)).coefficient_table(spark).collect()
    sizes = [abs(r["coefficient"]) for r in table]
    assert sizes == sorted(sizes, reverse=True) and table[0]["feature"] == "momentum_score" and len(table) == 5


def test_standardisation_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = {r["feature"]: (r["mean"], r["scale"]) for r in predictor.standardisation(df, ["a", "b"]).collect()}
    assert out == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_class_check(spark):
    out = predictor.class_check(spark.createDataFrame([(1,), (0,), (None,), (1,)], "outperformed int")).first()
    assert tuple(out) == (3, 2, pytest.approx(2 / 3), True)
