"""Monthly macro regimes, their spells, and their attachment to the panel.

Regime tables hold one row per month and ``by`` key, so windows over time are short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import growth, rolling, series_window, trailing
from panelwright.operators.asof import asof_backward

Keys = Sequence[str]
UNKNOWN = "UNKNOWN"


def rate_regime(macro: DataFrame, by: Keys = ()) -> DataFrame:
    """HIKING above the 3-month mean rate, CUTTING below it, otherwise (also when unknown) NEUTRAL."""
    if "tbill_rate" not in macro.columns:
        return macro.withColumn("rate_regime", F.lit(UNKNOWN))
    rate = F.col("tbill_rate")
    averaged = macro.withColumn("rate_3m_avg", rolling(F.avg(rate), rate, trailing(by, 3), 2))
    mean = F.col("rate_3m_avg")
    return averaged.withColumn(
        "rate_regime", F.when(rate > mean, "HIKING").when(rate < mean, "CUTTING").otherwise("NEUTRAL")
    )


def inflation_regime(macro: DataFrame) -> DataFrame:
    """LOW up to and including 3, TARGET up to and including 6, HIGH above; the text "nan" when unknown."""
    if "cpi_yoy_pct" not in macro.columns:
        return macro.withColumn("inflation_regime", F.lit(UNKNOWN))
    rate = F.col("cpi_yoy_pct")
    return macro.withColumn(
        "inflation_regime",
        F.when(rate <= fixed.INFLATION_LOW, "LOW_INFLATION")
        .when(rate <= fixed.INFLATION_HIGH, "TARGET_INFLATION")
        .when(rate > fixed.INFLATION_HIGH, "HIGH_INFLATION")
        .otherwise("nan"),
    )


def currency_regime(macro: DataFrame, by: Keys = ()) -> DataFrame:
    """WEAK when the currency lost more than 2 % in 3 months, STRONG when it gained as much, otherwise STABLE."""
    if "zar_usd" not in macro.columns:
        return macro.withColumn("currency_regime", F.lit(UNKNOWN))
    moved = growth(F.col("zar_usd"), F.lag("zar_usd", 3).over(series_window(by))) * 100
    changed = macro.withColumn("zar_3m_change", moved)
    change = F.col("zar_3m_change")
    return changed.withColumn(
        "currency_regime",
        F.when(change > fixed.CURRENCY_MOVE_PCT, "WEAK_RAND")
        .when(change < -fixed.CURRENCY_MOVE_PCT, "STRONG_RAND")
        .otherwise("STABLE_RAND"),
    )


def spell_positions(df: DataFrame, state: str = "composite_regime", by: Keys = (), order: str = "date") -> DataFrame:
    """Add ``regime_changed`` (1 on the first row of a spell), ``spell`` (its number) and ``regime_duration``."""
    w = W.partitionBy(*by).orderBy(order)
    previous = F.lag(state).over(w)
    first = F.row_number().over(w) == 1
    started = df.withColumn("regime_changed", F.when(first | ~F.col(state).eqNullSafe(previous), 1).otherwise(0))
    numbered = started.withColumn("spell", F.sum("regime_changed").over(w.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy(*by, "spell").orderBy(order)
    return numbered.withColumn("regime_duration", F.row_number().over(within))


def classify_regimes(macro: DataFrame, by: Keys = ()) -> DataFrame:
    """Regime table: labels and the running duration in months."""
    labelled = currency_regime(inflation_regime(rate_regime(macro, by)), by)
    composed = labelled.withColumn("composite_regime", F.concat_ws("_", "rate_regime", "inflation_regime"))
    spelled = spell_positions(composed, by=by)
    wanted = [*by, "date", "tbill_rate", "cpi_yoy_pct", "zar_usd", "rate_regime", "inflation_regime"]
    wanted += ["currency_regime", "composite_regime", "regime_duration"]
    return spelled.select(*[c for c in wanted if c in spelled.columns])


def attach_regimes(panel: DataFrame, regimes: DataFrame, by: Keys = ()) -> DataFrame:
    """Panel with the regime in force on each day."""
    wanted = [*by, "date", "rate_regime", "inflation_regime", "currency_regime", "composite_regime", "regime_duration"]
    return asof_backward(panel, regimes.select(*[c for c in wanted if c in regimes.columns]), by=by)


def months_per_regime(regimes: DataFrame, by: Keys = ()) -> DataFrame:
    known = regimes.where(F.col("composite_regime").isNotNull())
    return known.groupBy(*by, F.col("composite_regime").alias("regime")).agg(F.count(F.lit(1)).alias("total_months"))


def spells(regimes: DataFrame, by: Keys = ()) -> DataFrame:
    """One row per uninterrupted run of a regime."""
    known = regimes.where(F.col("composite_regime").isNotNull()).select(*by, "date", "composite_regime")
    return (
        spell_positions(known, by=by)
        .groupBy(*by, "spell")
        .agg(
            F.first("composite_regime").alias("regime"),
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count("date").alias("months"),
        )
        .drop("spell")
    )


def spell_summary(regimes: DataFrame, by: Keys = ()) -> DataFrame:
    """Months, mean spell length and number of spells per regime, the most frequent first."""
    return (
        spells(regimes, by)
        .groupBy(*by, "regime")
        .agg(
            F.sum("months").alias("total_months"),
            F.round(F.avg("months"), 1).alias("avg_spell_length_months"),
            F.count(F.lit(1)).alias("num_spells"),
        )
        .orderBy(F.desc("total_months"), "regime")
    )
