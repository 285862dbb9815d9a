"""Expressions that give NULL, never an error, NaN or infinity, where a statistic is undefined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def growth(now: Column, earlier: Column) -> Column:
    """now / earlier - 1; NULL when either is missing or the base is zero."""
    return ratio(now, earlier) - F.lit(1.0)


def padded(value: Column, keys: Sequence[str], pad: bool, order: str = "date") -> Column:
    """The value itself, or with ``pad`` the last known value of the series up to this row."""
    if not pad:
        return value
    so_far = series_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(so_far)


def series_window(keys: Sequence[str], order: str = "date") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def trailing(keys: Sequence[str], rows: int, order: str = "date") -> WindowSpec:
    """The current row and the ``rows - 1`` rows before it."""
    return series_window(keys, order).rowsBetween(-(rows - 1), 0)


def rolling(aggregate: Column, counted: Column, window: WindowSpec, min_count: int) -> Column:
    """``aggregate`` over ``window``, NULL until ``min_count`` non-null values of ``counted`` are inside it."""
    return F.when(F.count(counted).over(window) >= min_count, aggregate.over(window))


def standard_score(value: Column, mean: Column, deviation: Column, low: Column, high: Column) -> Column:
    """(value - mean) / deviation, NULL when all values are equal.

    The range test is exact, whereas the deviation of equal values may come out as rounding noise.
    """
    return F.when(low < high, ratio(value - mean, deviation))


def pearson(x: Column, y: Column, min_pairs: int = 2, window: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both inputs are present, as an aggregate or over a window.

    The built-in ``corr`` raises on a constant input in ANSI mode; here a constant side gives NULL.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)

    def of(aggregate: Column) -> Column:
        return aggregate if window is None else aggregate.over(window)

    spread = of(F.stddev_pop(px)) * of(F.stddev_pop(py))
    value = ratio(of(F.covar_pop(px, py)), spread)
    usable = (
        (of(F.count(px)) >= min_pairs)
        & (of(F.min(px)) < of(F.max(px)))
        & (of(F.min(py)) < of(F.max(py)))
    )
    clamped = F.when(value > 1.0, 1.0).when(value < -1.0, -1.0).otherwise(value)
    return F.when(usable, clamped)


def number_or_null(value: Column) -> Column:
    """Parse as double; unparsable text and NaN become NULL."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)
