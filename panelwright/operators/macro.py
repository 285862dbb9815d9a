"""Monthly macro table from mixed-frequency series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import growth, padded, series_window
from panelwright.operators.fill import capped_ffill

Keys = Sequence[str]


def monthly_macro(
    raw: DataFrame,
    fx_columns: Sequence[str] = fixed.FX_COLUMNS,
    fill_limit: int = fixed.MACRO_FILL_LIMIT,
    by: Keys = (),
) -> DataFrame:
    """One row per month end, without gaps between the first and last month.

    FX columns are averaged over the month, all others take their last non-null reading; then gaps are filled for at
    most ``fill_limit`` months. Both resamplings are one aggregation that combines before the shuffle. Missing months
    are made by stretching each month up to the next one, on rows that number at most one per month and ``by`` key.
    """
    by = list(by)
    series = [c for c in raw.columns if c != "date" and c not in by]
    resampled = raw.groupBy(*by, F.trunc("date", "MM").alias("_month")).agg(
        *[
            F.avg(c).alias(c) if c in fx_columns else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
            for c in series
        ]
    )
    following = F.lead("_month").over(W.partitionBy(*by).orderBy("_month"))
    until = F.coalesce(F.add_months(following, -1), F.col("_month"))
    spine = resampled.withColumn("_until", until).withColumn(
        "_slot", F.explode_outer(F.sequence(F.col("_month"), F.col("_until"), F.expr("interval 1 month")))
    )
    real = F.col("_slot") == F.col("_month")
    dense = spine.select(
        *by, F.last_day("_slot").alias("date"), *[F.when(real, F.col(c)).alias(c) for c in series]
    )
    return capped_ffill(dense, series, fill_limit, by)


def macro_changes(monthly: DataFrame, by: Keys = (), pad: bool = False) -> DataFrame:
    """Month-on-month FX change, CPI year on year, real rate and curve spread, for the columns that exist.

    ``pad`` lets the changes look across gaps that outlasted the fill.
    """
    w = series_window(by)
    have = set(monthly.columns)
    out = monthly
    for name, source, months in (("zar_usd_mom_pct", "zar_usd", 1), ("cpi_yoy_pct", "cpi_all", 12)):
        if source in have:
            based = out.withColumn("_base", padded(F.col(source), by, pad))
            out = based.withColumn(name, growth(F.col("_base"), F.lag("_base", months).over(w)) * 100).drop("_base")
    if {"tbill_rate", "cpi_all"} <= have:
        out = out.withColumn("real_tbill_rate", F.col("tbill_rate") - F.col("cpi_yoy_pct"))
    if {"govt_bond_10y", "tbill_rate"} <= have:
        out = out.withColumn("yield_curve_spread", F.col("govt_bond_10y") - F.col("tbill_rate"))
    return out


def process_macro(raw: DataFrame, by: Keys = (), pad: bool = False) -> DataFrame:
    return macro_changes(monthly_macro(raw, by=by), by, pad)
