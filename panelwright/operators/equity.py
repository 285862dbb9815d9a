"""Return, volatility, 52-week range and calendar columns of a daily price panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import growth, number_or_null, padded, ratio, rolling, series_window, trailing
from panelwright.operators.fill import capped_ffill
from panelwright.operators.rolling import window_max, window_min, window_total, with_window_parts

Keys = Sequence[str]


def coerce_numeric(df: DataFrame, columns: Sequence[str] = fixed.PRICE_COLUMNS) -> DataFrame:
    """Cast the named columns that exist to double; whatever cannot be parsed becomes NULL."""
    return df.withColumns({c: number_or_null(F.col(c)) for c in columns if c in df.columns})


def daily_returns(prices: DataFrame, keys: Keys = ("ticker",), pad: bool = False) -> DataFrame:
    """Simple and log return against the previous row. ``pad`` lets the simple return look across gaps."""
    w = series_window(keys)
    close = F.col("close")
    based = prices.withColumn("_base", padded(close, keys, pad))
    return based.withColumns(
        {
            "daily_return": growth(F.col("_base"), F.lag("_base", 1).over(w)),
            "log_return": F.ln(ratio(close, F.lag(close, 1).over(w))),
        }
    ).drop("_base")


def volatility(prices: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    """Annualised sample deviation of the log return over 21 rows."""
    w = trailing(keys, fixed.VOLATILITY_ROWS)
    deviation = rolling(F.stddev_samp("log_return"), F.col("log_return"), w, fixed.VOLATILITY_MIN)
    return prices.withColumn("volatility_21d", deviation * F.sqrt(F.lit(float(fixed.TRADING_DAYS_PER_YEAR))))


def year_range(prices: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    """Highest and lowest close over 252 rows and the distance from the high."""
    parts = {"n": "count(close)", "high": "max(close)", "low": "min(close)"}
    enough = F.expr(f"{window_total('n')} >= {fixed.YEAR_MIN}")
    ranged = with_window_parts(prices, parts, fixed.YEAR_ROWS, keys).select(
        *prices.columns,
        F.when(enough, F.expr(window_max("high"))).alias("high_52w"),
        F.when(enough, F.expr(window_min("low"))).alias("low_52w"),
    )
    return ranged.withColumn("pct_from_52w_high", F.expr("try_divide(close - high_52w, high_52w)"))


def calendar_features(df: DataFrame, order: str = "date") -> DataFrame:
    """Year, month, quarter and weekday with Monday = 0."""
    return df.withColumns(
        {
            "year": F.year(order),
            "month": F.month(order),
            "quarter": F.quarter(order),
            "day_of_week": F.weekday(order),
        }
    )


def process_prices(prices: DataFrame, keys: Keys = ("ticker",), pad: bool = False) -> DataFrame:
    """Processed price table: numeric columns, filled close, and all feature columns.

    All windows share one hash partitioning by key.
    """
    filled = capped_ffill(coerce_numeric(prices), ["close"], fixed.PRICE_FILL_LIMIT, keys)
    featured = year_range(volatility(daily_returns(filled, keys, pad), keys), keys)
    return calendar_features(featured)
