"""Gap handling: calendar densification and capped forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.guarded import series_window


def carried_forward(value: Column, limit: int, keys: Sequence[str], order: str = "date") -> Column:
    """The value, or the last one at most ``limit`` rows back: a gap is filled for its first ``limit`` rows only."""
    return F.last(value, ignorenulls=True).over(series_window(keys, order).rowsBetween(-limit, 0))


def capped_ffill(
    df: DataFrame, columns: Sequence[str], limit: int, keys: Sequence[str] = ("ticker",), order: str = "date"
) -> DataFrame:
    return df.withColumns({c: carried_forward(F.col(c), limit, keys, order) for c in columns})


def densify(panel: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """One row per key and calendar day between the key's first and last day; added rows are NULL elsewhere.

    Each row is stretched up to the day before the key's next one, so neither a join nor a calendar table is needed.
    """
    others = [c for c in panel.columns if c not in keys and c != order]
    following = F.lead(order).over(W.partitionBy(*keys).orderBy(order))
    until = F.coalesce(F.date_sub(following, 1), F.col(order))
    stretched = panel.withColumn("_until", until).withColumn(
        "_day", F.explode_outer(F.sequence(F.col(order), F.col("_until"), F.expr("interval 1 day")))
    )
    real = F.col("_day") == F.col(order)
    values = {c: F.when(real, F.col(c)).alias(c) for c in others}
    return stretched.select(
        *[F.col("_day").alias(order) if c == order else values.get(c, F.col(c)) for c in panel.columns]
    )
