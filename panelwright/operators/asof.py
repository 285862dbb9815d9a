"""Backward point-in-time joins and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Attach to each left row the latest right row dated on or before it. Left rows are kept as they are.

    The whole right row is taken even where its values are NULL; rows before the first reading get NULLs. ``on`` is a
    DATE on both sides; timestamps are taken by their day.

    Readings are spread over the days they are valid for, so the join becomes an equi-join on the day. The left side
    is read once and, without ``by``, never shuffled: the day table has one row per calendar day between the first and
    last reading and is broadcast. With ``by`` the day table grows with the keys, so Spark picks the strategy, and the
    join key (by, day) splits a hot ``by`` value over its days. Days after the last reading map onto the last reading.
    """
    by = list(by)
    carried = [c for c in right.columns if c != on and c not in by]
    right = right.withColumn(on, F.to_date(on))
    # One row per reading day: should a day repeat, the greatest row is taken so that the choice is deterministic.
    readings = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*carried)).alias("_row"))
    horizon = right.select(F.max(on).alias("_horizon")).scalar()
    following = F.lead(on).over(W.partitionBy(*by).orderBy(on))
    # Without keys the readings are few and already in one place, so the last one is found without the extra query.
    end = horizon if by else F.max(on).over(W.partitionBy())
    # The outer form keeps the optimizer from repeating the sequence in a filter of its own.
    days = readings.withColumn("_until", F.coalesce(F.date_sub(following, 1), end)).select(
        *by,
        F.explode_outer(F.sequence(F.col(on), F.col("_until"), F.expr("interval 1 day"))).alias("_day"),
        "_row",
    )
    keyed = left.withColumn("_day", F.least(F.to_date(on), horizon))
    joined = keyed.join(days if by else F.broadcast(days), [*by, "_day"], "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.col("_row")[c].alias(c) for c in carried])


def annual_readings(annual: DataFrame, publication_lag_months: int = 0) -> DataFrame:
    """Turn a table keyed by year into readings dated 1 January of that year, later by the publication lag."""
    start = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    return annual.where(F.col("year").isNotNull()).select(
        F.add_months(start, publication_lag_months).alias("date"),
        *[c for c in annual.columns if c not in ("year", "date")],
    )


def build_master(
    prices: DataFrame,
    macro: DataFrame,
    annual: DataFrame | None = None,
    by: Sequence[str] = (),
    publication_lag_months: int = 0,
) -> DataFrame:
    """Price panel with point-in-time macro and, when given, annual columns. Row count equals that of ``prices``."""
    lagged = macro
    if publication_lag_months:
        lagged = macro.withColumn("date", F.last_day(F.add_months("date", publication_lag_months)))
    master = asof_backward(prices, lagged, by=by)
    if annual is None:
        return master
    return asof_backward(master, annual_readings(annual, publication_lag_months), by=by)


def snapshot_asof(panel: DataFrame, day: Column, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Per key, the last non-null value of every column on or before ``day``.

    Columns may come from different rows. The aggregation combines before the shuffle, so long series do no harm.
    """
    values = [c for c in panel.columns if c not in keys]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values if c != order]
    kept = panel.where(F.col(order) <= day)
    return kept.groupBy(*keys).agg(F.max(order).alias(order), *latest).select(*panel.columns)
