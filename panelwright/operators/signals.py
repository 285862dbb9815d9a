"""Momentum, mean reversion, trend and RSI columns on the master panel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import growth, padded, ratio, rolling, series_window, standard_score, trailing
from panelwright.operators.rolling import window_total, with_window_parts

Keys = Sequence[str]
#: Weights within a block stay below ten to this power, far from the end of double range.
RSI_WEIGHT_DIGITS = 250


def momentum(
    panel: DataFrame, keys: Keys = ("ticker",), windows: dict[str, int] = fixed.MOMENTUM_ROWS, pad: bool = False
) -> DataFrame:
    """Return over n rows ending at the previous row, so that the latest day never enters."""
    w = series_window(keys)
    based = panel.withColumn("_base", padded(F.col("close"), keys, pad))
    recent = F.lag("_base", 1).over(w)
    moved = based.withColumns({c: growth(recent, F.lag("_base", 1 + n).over(w)) for c, n in windows.items()})
    return moved.drop("_base")


def cross_section_z(
    panel: DataFrame,
    columns: Sequence[str] = tuple(fixed.MOMENTUM_ROWS),
    on: Sequence[str] = ("date",),
    exclude: Sequence[str] = (),
    key: str = "ticker",
) -> DataFrame:
    """Add ``<column>_z``: the score of each value among all series of the same day.

    Series named in ``exclude`` (say, indices) are scored but do not enter the moments.

    The daily moments come from an aggregation that combines before the shuffle, and are joined back. A window by day
    would move the whole panel and give each day, however many series it has, to one task.
    """
    on = list(on)
    counted = panel.where(~F.col(key).isin(*exclude)) if exclude else panel
    stats = counted.groupBy(*on).agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("deviation"),
                F.min(c).alias("low"),
                F.max(c).alias("high"),
            ).alias(f"_{c}")
            for c in columns
        ]
    )
    # One row per calendar day at most, so the broadcast has a fixed bound; any other key is left to Spark's size check.
    daily = len(on) == 1 and isinstance(panel.schema[on[0]].dataType, T.DateType)
    small = F.broadcast(stats) if daily else stats
    scored = panel.join(small, on, "left").withColumns(
        {
            f"{c}_z": standard_score(
                F.col(c),
                F.col(f"_{c}.mean"),
                F.col(f"_{c}.deviation"),
                F.col(f"_{c}.low"),
                F.col(f"_{c}.high"),
            )
            for c in columns
        }
    )
    return scored.select(*panel.columns, *[f"{c}_z" for c in columns])


def momentum_score(panel: DataFrame, weights: dict[str, float] = fixed.MOMENTUM_WEIGHTS) -> DataFrame:
    """Weighted sum of momentum scores; a missing score counts as zero."""
    total: Column = F.lit(0.0)
    for column, weight in weights.items():
        total = total + F.lit(weight) * F.coalesce(F.col(column), F.lit(0.0))
    return panel.withColumn("momentum_score", total)


def price_z(panel: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    """Score of the close within its own last 20 rows."""
    w = trailing(keys, fixed.PRICE_Z_ROWS)
    close = F.col("close")
    score = standard_score(
        close,
        F.avg(close).over(w),
        F.stddev_samp(close).over(w),
        F.min(close).over(w),
        F.max(close).over(w),
    )
    return panel.withColumn("price_z_20d", F.when(F.count(close).over(w) >= fixed.PRICE_Z_MIN, score))


def moving_averages(panel: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    """50-row and 200-row mean of the close, and their ratio."""
    close = F.col("close")
    fast = rolling(F.avg(close), close, trailing(keys, fixed.FAST_MA_ROWS), fixed.FAST_MA_MIN)
    parts = {"n": "count(close)", "total": "sum(close)"}
    n, total = window_total("n"), window_total("total")
    slow = F.expr(f"CASE WHEN {n} >= {fixed.SLOW_MA_MIN} THEN {total} / {n} END")
    averaged = with_window_parts(panel.withColumn("ma_50", fast), parts, fixed.SLOW_MA_ROWS, keys).select(
        *panel.columns, "ma_50", slow.alias("ma_200")
    )
    return averaged.withColumn("ma_ratio_50_200", ratio(F.col("ma_50"), F.col("ma_200")))


def trend_signal(panel: DataFrame) -> DataFrame:
    """1 above, -1 below, 0 when equal or unknown."""
    fast, slow = F.col("ma_50"), F.col("ma_200")
    return panel.withColumn("trend_signal", F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0))


def _rsi_block(decay: float) -> int:
    """Rows after which decay**-row has reached its limit."""
    return max(1, int(RSI_WEIGHT_DIGITS / -math.log10(decay))) if decay > 0 else 1


def rsi(
    panel: DataFrame,
    keys: Keys = ("ticker",),
    rows: int = fixed.RSI_ROWS,
    position: str | None = None,
    column: str = "rsi_14",
) -> DataFrame:
    """Relative strength index from exponentially weighted mean gains and losses.

    The index needs only the ratio of the two means, so their common normalisation cancels and each mean can be a plain
    running sum of gain * decay**-row. To stay inside double range the sums restart after a block of rows whose length
    follows from ``rows``, and each block takes over the decayed total of all blocks before it. ``position`` names an existing 0-based row number; without it rows are numbered here.
    """
    w = series_window(keys)
    decay = (rows - 1) / rows
    block = _rsi_block(decay)
    at = F.col(position) if position else F.row_number().over(w) - 1
    moved = panel.withColumns({"_at": at, "_change": F.col("close") - F.lag("close", 1).over(w)})
    moved = moved.withColumns(
        {
            "_block": F.expr(f"_at div {block}"),
            "_slot": F.expr(f"_at % {block}"),
            "_known": F.count("_change").over(w.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    inside = W.partitionBy(*keys, "_block").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    weight = f"pow({decay!r}D, -_slot)"
    summed = moved.withColumns(
        {
            "_up": F.expr(f"sum(coalesce(greatest(_change, 0D), 0D) * {weight})").over(inside),
            "_down": F.expr(f"sum(coalesce(greatest(-_change, 0D), 0D) * {weight})").over(inside),
        }
    )
    closing = F.expr(f"CASE WHEN _slot = {block - 1} THEN named_struct('b', _block, 'u', _up, 'd', _down) END")
    earlier = W.partitionBy(*keys).orderBy("_block", "_slot").rowsBetween(W.unboundedPreceding, -1)
    carried = summed.withColumn("_closing", closing)
    # One closing a block: a handful even for the longest series of days.
    carried = carried.withColumn("_closings", F.collect_list("_closing").over(earlier))
    # A block's total is scaled to slot 0 of its own block; seen from the next block it has decayed by a block's rows.
    step = f"pow({decay!r}D, {block})"
    total = f"""aggregate(_closings, named_struct('u', 0D, 'd', 0D),
                  (a, x) -> named_struct('u', a.u * {step} + x.u, 'd', a.d * {step} + x.d))"""
    carried = carried.withColumn("_last", F.when(F.size("_closings") > 0, F.expr(total)))
    faded = step
    means = carried.withColumns(
        {
            "_up": F.expr(f"_up + coalesce(_last.u * {faded}, 0D)"),
            "_down": F.expr(f"_down + coalesce(_last.d * {faded}, 0D)"),
        }
    )
    index = F.expr(
        f"""CASE WHEN _known < {rows} THEN NULL
                 WHEN _down = 0 AND _up > 0 THEN 100D
                 WHEN _up = 0 AND _down > 0 THEN 0D
                 WHEN _up > 0 AND _down > 0 THEN 100D - 100D / (1D + _up / _down) END"""
    )
    return means.select(*panel.columns, index.alias(column))


def compute_signals(
    master: DataFrame, keys: Keys = ("ticker",), pad: bool = False, exclude: Sequence[str] = ()
) -> DataFrame:
    """All signal columns. One shuffle by key for the windows; the daily moments are broadcast."""
    series = rsi(trend_signal(moving_averages(price_z(momentum(master, keys, pad=pad), keys), keys)), keys)
    return momentum_score(cross_section_z(series, exclude=exclude, key=keys[0]))
