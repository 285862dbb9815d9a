"""Parameterised reads behind an interactive view."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.operators.asof import snapshot_asof

SIGNAL_COLUMNS = ("momentum_score", "rsi_14", "trend_signal", "mom_1m", "mom_3m", "mom_6m")
MACRO_VIEW_COLUMNS = ("tbill_rate", "cpi_all", "zar_usd", "zar_usd_mom_pct")


def ticker_slice(panel: DataFrame, ticker: str, start: date | str, end: date | str) -> DataFrame:
    """One series between two days, both included; the filters reach the scan."""
    day = F.col("date")
    return panel.where(
        (F.col("ticker") == ticker) & (day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))
    )


def correlation_slice(correlations: DataFrame, ticker: str, variable: str) -> DataFrame:
    return correlations.where((F.col("ticker") == ticker) & (F.col("macro_var") == variable))


def macro_view(macro: DataFrame, columns: Sequence[str] = MACRO_VIEW_COLUMNS) -> DataFrame:
    return macro.select("date", *[c for c in columns if c in macro.columns]).orderBy("date")


def latest_regime(regimes: DataFrame) -> DataFrame:
    """Regime in force, months since it began, and the readings behind it."""
    wanted = ["date", "composite_regime", "regime_duration", "tbill_rate", "cpi_yoy_pct"]
    known = regimes.where(F.col("composite_regime").isNotNull())
    return known.orderBy(F.desc("date")).limit(1).select(*[c for c in wanted if c in regimes.columns])


def signal_snapshot(panel: DataFrame, day: date | str) -> DataFrame:
    """Latest known signals of every series on a day, strongest momentum last, rounded to 4 places."""
    wanted = [c for c in ("ticker", "name", *SIGNAL_COLUMNS) if c in panel.columns]
    latest = snapshot_asof(panel.select("date", *wanted), F.lit(day).cast("date"))
    shown = latest.select(*[F.round(c, 4).alias(c) if latest.schema[c].dataType.typeName() == "double" else c for c in wanted])
    return shown.orderBy("momentum_score", "ticker") if "momentum_score" in wanted else shown


def panel_catalog(panel: DataFrame) -> DataFrame:
    """One row per series: a name, its first and last day, and its number of rows."""
    name = F.max_by("name", "date") if "name" in panel.columns else F.first("ticker")
    return panel.groupBy("ticker").agg(
        name.alias("name"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count(F.lit(1)).alias("n_rows"),
    ).orderBy("ticker")


def available_variables(panel: DataFrame) -> list[str]:
    return [v for v in fixed.CORRELATION_VARIABLES if v in panel.columns]
