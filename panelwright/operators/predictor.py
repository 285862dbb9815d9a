"""Outperformance label, feature matrix and logistic model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.lineage import keep_for_reuse
from panelwright.operators.newton import Moments, fit_all
from panelwright.operators.regime_returns import forward_return

Keys = Sequence[str]
REGIME = "composite_regime"
LABEL = "outperformed"
SOLVER_TOLERANCE = 1e-10


def outperformance_label(
    panel: DataFrame, index_ticker: str = fixed.INDEX_TICKER, rows: int = fixed.FORWARD_ROWS
) -> DataFrame:
    """Add the forward return, the index's forward return of the same day, and 1/0 for beating it (NULL if unknown).

    The index is one series, so its side of the join has one row per day and is broadcast. Its return needs only its
    own rows: the filter on the ticker reaches the scan instead of running the window over all series twice.
    """
    index = forward_return(panel.where(F.col("ticker") == index_ticker).select("ticker", "date", "close"), rows)
    by_day = index.groupBy("date").agg(F.first("fwd_return_21d").alias("alsi_fwd_return_21d"))
    joined = forward_return(panel, rows).join(F.broadcast(by_day), "date", "left")
    own, other = F.col("fwd_return_21d"), F.col("alsi_fwd_return_21d")
    beat = F.when(own > other, 1).when(own <= other, 0)
    return joined.withColumn(LABEL, beat).select(
        *panel.columns, "fwd_return_21d", "alsi_fwd_return_21d", LABEL
    )


def chronological_split(df: DataFrame, cutoff: Column, order: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows strictly before the cutoff, and rows on or after it."""
    return df.where(F.col(order) < cutoff), df.where(F.col(order) >= cutoff)


def training_rows(df: DataFrame, features: Sequence[str] = fixed.MODEL_FEATURES) -> DataFrame:
    """Rows with a label, a regime and all features."""
    return df.dropna(subset=[*features, REGIME, LABEL])


def class_check(df: DataFrame) -> DataFrame:
    """Labelled rows, distinct labels, base rate, and whether a model can be fitted."""
    return df.where(F.col(LABEL).isNotNull()).agg(
        F.count(LABEL).alias("n_rows"),
        F.count_distinct(LABEL).alias("n_classes"),
        F.avg(LABEL).alias("base_rate"),
    ).withColumn("trainable", F.col("n_classes") == 2)


def regime_vocabulary(df: DataFrame) -> list[str]:
    """Sorted regime labels in use. Labels are a handful of fixed words, so the list is small."""
    return sorted(r[REGIME] for r in df.select(REGIME).where(F.col(REGIME).isNotNull()).distinct().toLocalIterator())


def feature_columns(features: Sequence[str], vocabulary: Sequence[str]) -> dict[str, Column]:
    """Numeric features as double and one 0/1 column per known regime; an unknown regime is all zero."""
    numeric = {f: F.col(f).cast("double") for f in features}
    flags = {f"regime_{v}": F.when(F.col(REGIME) == v, 1.0).otherwise(0.0) for v in vocabulary}
    return {**numeric, **flags}


def feature_matrix(
    df: DataFrame, vocabulary: Sequence[str], features: Sequence[str] = fixed.MODEL_FEATURES, keep: Keys = ()
) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in feature_columns(features, vocabulary).items()])


def standardisation(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population deviation, with 1 in place of a zero deviation."""
    moments = matrix.agg(
        *[
            F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale")).alias(c)
            for c in columns
        ]
    )
    rows = moments.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("m")).select("m.*")
    return rows.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


@dataclass(frozen=True)
class RegimeModel:
    """Fitted coefficients on the standardised scale, with everything needed to score new rows."""

    features: tuple[str, ...]
    vocabulary: tuple[str, ...]
    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    base_rate: float
    n_rows: int
    iterations: int = 0
    gradient_norm: float = 0.0
    converged: bool = True

    def score(self) -> Column:
        """Probability of class 1 as one expression; NULL where a feature or the regime is missing."""
        total: Column = F.lit(self.intercept)
        columns = feature_columns(self.features, self.vocabulary)
        for name, mean, scale, weight in zip(self.names, self.means, self.scales, self.coefficients, strict=True):
            total = total + (columns[name] - F.lit(mean)) * F.lit(weight / scale)
        return F.when(F.col(REGIME).isNotNull(), logistic(total))

    def predict(self, df: DataFrame, column: str = "predicted_proba") -> DataFrame:
        return df.withColumn(column, self.score())

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.names, self.coefficients, strict=True))
        table = spark.createDataFrame(rows, "feature string, coefficient double")
        return table.orderBy(F.abs("coefficient").desc(), "feature")


def fit_model(
    train: DataFrame, features: Sequence[str] = fixed.MODEL_FEATURES, c: float = 1.0, max_iter: int = 1000
) -> RegimeModel:
    """L2-penalised logistic regression on standardised features, intercept unpenalised.

    Spark's solver minimises the mean loss, so the penalty 1/(2c) on the summed loss becomes 1/(c n). It stops where the
    loss hardly falls any more; a few Newton steps from there bring the gradient down to ``newton.GRADIENT_TOLERANCE``. The
    model says after how many, and whether they did.
    """
    rows = keep_for_reuse(training_rows(train, features).select(*features, REGIME, F.col(LABEL).cast("double").alias(LABEL)))
    try:
        vocabulary = regime_vocabulary(rows)
        columns = feature_columns(features, vocabulary)
        names = list(columns)
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("rate")).first()
        if not sizes["n"] or sizes["rate"] in (0.0, 1.0):
            raise ValueError("training rows must contain both classes")
        matrix = rows.select(LABEL, *[columns[n].alias(n) for n in names])
        scaling = {r["feature"]: r for r in standardisation(matrix, names).collect()}
        means = [scaling[n]["mean"] for n in names]
        scales = [scaling[n]["scale"] for n in names]
        scaled = matrix.select(
            LABEL,
            *[((F.col(f"`{n}`") - m) / s).alias(f"z{k}") for k, (n, m, s) in enumerate(zip(names, means, scales))],
        )
        assembler = VectorAssembler(inputCols=[f"z{k}" for k in range(len(names))], outputCol="_features")
        solver = LogisticRegression(
            featuresCol="_features",
            labelCol=LABEL,
            regParam=1.0 / (c * sizes["n"]),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=SOLVER_TOLERANCE,
        )
        fitted = solver.fit(assembler.transform(scaled))
        start = np.array([float(fitted.intercept), *(float(v) for v in fitted.coefficients)])
        moments = Moments(sizes["n"], sizes["rate"] * sizes["n"], np.array(means), np.array(scales))
        numbered = matrix.select(F.lit(0).alias("_period"), F.col(LABEL).alias("_label"), *[F.col(f"`{n}`") for n in names])
        fit = fit_all(numbered, {0: moments}, c, {0: start})[0]
    finally:
        rows.unpersist()
    return RegimeModel(
        tuple(features),
        tuple(vocabulary),
        tuple(names),
        tuple(means),
        tuple(scales),
        tuple(float(v) for v in fit.weights[1:]),
        float(fit.weights[0]),
        float(sizes["rate"]),
        int(sizes["n"]),
        fit.iterations,
        fit.gradient_norm,
        fit.converged,
    )


