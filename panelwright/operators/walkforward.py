"""Walk-forward evaluation: one logistic model per rebalance date, all dates fitted together.

Each date's model is trained on all earlier rows. Fitting date by date would read the training table once per date and
iteration; here a Newton iteration is one pass for all dates (see ``newton``). The number of dates is the number of months.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.lineage import keep_for_reuse
from panelwright.operators.backtest import period_results, rebalance_dates, top_picks
from panelwright.operators.newton import GRADIENT_TOLERANCE, MAX_ITERATIONS, Fit, cumulative_moments, fit_all
from panelwright.operators.predictor import LABEL, feature_columns, logistic, regime_vocabulary, training_rows

RESULT_SCHEMA = (
    "rebalance_date date, picked_tickers string, portfolio_return double, alsi_return double, "
    "excess_return double, net_excess_return double, beat_alsi boolean"
)
FIT_SCHEMA = "rebalance_date date, train_rows bigint, iterations int, gradient_norm double, converged boolean"


@dataclass(frozen=True)
class DatedModels:
    """One model per date on the raw feature scale: probability = logistic(intercept + weights . features)."""

    dates: list
    names: list[str]
    intercepts: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray  # on the standardised scale, comparable between features
    train_rows: list[int]
    fits: list[Fit]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d, float(b), [float(v) for v in w])
            for d, b, w in zip(self.dates, self.intercepts, self.weights, strict=True)
        ]
        return spark.createDataFrame(rows, "date date, _intercept double, _weights array<double>")

    def fit_table(self, spark: SparkSession) -> DataFrame:
        """How each date's fit ended: passes over the rows, largest gradient entry, and whether that is small enough."""
        rows = [(d, n, f.iterations, f.gradient_norm, f.converged) for d, n, f in zip(self.dates, self.train_rows, self.fits, strict=True)]
        return spark.createDataFrame(rows, FIT_SCHEMA)

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = [(d, n, float(v)) for d, w in zip(self.dates, self.coefficients, strict=True) for n, v in zip(self.names, w, strict=True)]
        return spark.createDataFrame(rows, "rebalance_date date, feature string, coefficient double")


def fit_dated_models(
    panel: DataFrame,
    dates: DataFrame,
    features: Sequence[str] = fixed.MODEL_FEATURES,
    c: float = 1.0,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = GRADIENT_TOLERANCE,
) -> DatedModels | None:
    """Fit one model per row of ``dates`` (rebalance_date, cutoff) on the panel rows dated before its cutoff.

    Dates whose training rows lack one of the classes get no model. None is returned when no date can be fitted. A date
    that has not converged within ``max_iterations`` keeps its best weights and is marked in ``fit_table``.
    """
    schedule = [r for r in dates.orderBy("rebalance_date").collect() if r["cutoff"] is not None]
    usable = training_rows(panel, features)
    vocabulary = regime_vocabulary(usable)
    if not schedule or not vocabulary:
        return None
    columns = feature_columns(features, vocabulary)
    names = list(columns)
    # First date whose training set contains the day; the map has one row per calendar day.
    passed = F.array(*[F.when(F.col("_day") >= F.lit(r["cutoff"]), 1) for r in schedule])
    periods = usable.select(F.col("date").alias("_day")).distinct().withColumn("_period", F.size(F.array_compact(passed)))
    rows = keep_for_reuse(
        usable.join(F.broadcast(periods), F.col("date") == F.col("_day"))
        .where(F.col("_period") < len(schedule))
        .select("_period", F.col(LABEL).cast("double").alias("_label"), *[columns[n].alias(n) for n in names])
    )
    try:
        moments = cumulative_moments(rows, names, len(schedule))
        if not moments:
            return None
        fits = fit_all(rows, moments, c, None, max_iterations, tolerance)
    finally:
        rows.unpersist()
    order = sorted(fits)
    raw = np.array([moments[at].to_standard().T @ fits[at].weights for at in order])
    standard = np.array([fits[at].weights for at in order])
    days = [schedule[at]["rebalance_date"] for at in order]
    return DatedModels(days, names, raw[:, 0], raw[:, 1:], standard[:, 1:], [int(moments[at].n) for at in order], [fits[at] for at in order])


def score_on_dates(
    panel: DataFrame, models: DatedModels, features: Sequence[str] = fixed.MODEL_FEATURES
) -> DataFrame:
    """Panel rows of the model dates with the probability from that date's model; NULL where an input is missing."""
    vocabulary = [n.removeprefix("regime_") for n in models.names[len(features) :]]
    columns = feature_columns(features, vocabulary)
    score = F.col("_intercept")
    for k, name in enumerate(models.names):
        score = score + F.col("_weights")[k] * columns[name]
    dated = panel.join(F.broadcast(models.table(panel.sparkSession)), "date")
    known = F.when(F.col("composite_regime").isNotNull(), logistic(score))
    return dated.withColumn("predicted_proba", known).drop("_intercept", "_weights")


def walk_forward(
    panel: DataFrame,
    top_n: int = fixed.TOP_PICKS,
    cost_bps: float = fixed.REBALANCE_COST_BPS,
    min_train_months: int = fixed.MIN_TRAIN_MONTHS,
    index_ticker: str = fixed.INDEX_TICKER,
    embargo_rows: int = 0,
    features: Sequence[str] = fixed.MODEL_FEATURES,
    exclude_from_training: Sequence[str] = (),
    max_iterations: int = MAX_ITERATIONS,
    with_status: bool = False,
) -> DataFrame:
    """Results per rebalance date from a labelled panel with features and regimes.

    The index is never picked. Its rows do take part in training unless named in ``exclude_from_training``.

    Dates without a fittable model or with fewer than ``top_n`` scored series are left out. With ``with_status``,
    a last column ``converged`` tells whether the date's fit did within ``max_iterations``.
    """
    schema = RESULT_SCHEMA + (", converged boolean" if with_status else "")
    needed = ["date", "ticker", *features, "composite_regime", LABEL, "fwd_return_21d", "alsi_fwd_return_21d"]
    rows = keep_for_reuse(panel.select(*needed))
    try:
        trained_on = rows.where(~F.col("ticker").isin(*exclude_from_training)) if exclude_from_training else rows
        models = fit_dated_models(trained_on, rebalance_dates(rows, min_train_months, embargo_rows), features, max_iterations=max_iterations)
        if models is None:
            return panel.sparkSession.createDataFrame([], schema)
        picks = top_picks(score_on_dates(rows, models, features), "predicted_proba", top_n, index_ticker)
        # One row per month: brought in here, so that the kept rows can be let go.
        results = period_results(picks, cost_bps).collect()
    finally:
        rows.unpersist()
    ended = {d: f.converged for d, f in zip(models.dates, models.fits, strict=True)}
    rows = [(*r, ended[r["rebalance_date"]]) if with_status else tuple(r) for r in results]
    return panel.sparkSession.createDataFrame(rows, schema)
