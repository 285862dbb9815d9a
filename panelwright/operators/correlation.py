"""Rolling correlation with macro variables and the static correlation matrix of returns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import ratio

Keys = Sequence[str]
SERIES_PER_BLOCK = 256
#: Windows that are worked out at once.
STEP_ROWS = 2048


def _window_correlations(value: np.ndarray, variable: np.ndarray, rows: int, min_pairs: int) -> np.ndarray:
    """Correlation of the last ``rows`` rows up to each, over those with both; NaN where undefined.

    Every window has its own means, so nothing is subtracted that was added before. A window is constant if its least and
    greatest value are equal, not if its spread comes out as rounding noise.
    """
    both = ~(np.isnan(value) | np.isnan(variable))
    out = np.full(len(value), np.nan)
    padded = [np.concatenate([np.zeros(rows - 1, a.dtype), a]) for a in (both, np.where(both, value, 0.0), np.where(both, variable, 0.0))]
    for start in range(0, len(value), STEP_ROWS):
        part = [sliding_window_view(a[start : start + STEP_ROWS + rows - 1], rows) for a in padded]
        met = part[0]
        n = met.sum(axis=1)
        enough = np.flatnonzero(n >= min_pairs)
        if not len(enough):
            continue
        met, x, y = (a[enough] for a in part)
        moving = np.ones(len(enough), bool)
        centred = []
        for a in (x, y):
            moving &= np.where(met, a, np.inf).min(axis=1) < np.where(met, a, -np.inf).max(axis=1)
            centred.append(np.where(met, a - (a.sum(axis=1) / n[enough])[:, None], 0.0))
        x, y = centred
        spread = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        moving &= spread > 0
        joint = np.einsum("ij,ij->i", x, y)
        out[start + enough[moving]] = np.clip(joint[moving] / spread[moving], -1.0, 1.0)
    return out


def rolling_correlations(
    panel: DataFrame,
    variables: Sequence[str] = fixed.CORRELATION_VARIABLES,
    rows: int = fixed.CORRELATION_ROWS,
    min_pairs: int = fixed.CORRELATION_MIN,
    keys: Keys = ("ticker",),
    value: str = "daily_return",
) -> DataFrame:
    """Long table of the trailing correlation of ``value`` with each variable that exists; undefined rows are left out.

    One shuffle by series. A series of the panel has a row per calendar day at most, so a group is small whatever the size
    of the table; its windows of all variables are worked out as matrices, a step of rows at a time.
    """
    present = [v for v in variables if v in panel.columns]
    named = panel if "name" in panel.columns else panel.withColumn("name", F.col(keys[0]))
    numbers = [F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((value, *present))]
    narrow = named.select(F.col("date").alias("_date"), F.struct("date", *keys, "name").alias("_row"), *keys, *numbers)
    kind = narrow.select("_row").schema.fields[0].dataType
    if not present:
        return panel.sparkSession.createDataFrame([], T.StructType([*kind.fields, T.StructField("macro_var", T.StringType()), T.StructField("rolling_corr", T.DoubleType())]))

    def correlate(series: pa.Table) -> pa.Table:
        series = series.sort_by("_date")
        columns = [series.column(f"_{k}").to_numpy().astype(float) for k in range(len(present) + 1)]
        parts = []
        for name, column in zip(present, columns[1:], strict=True):
            found = _window_correlations(columns[0], column, rows, min_pairs)
            kept = np.flatnonzero(~np.isnan(found))
            parts.append(pa.table([series.column("_row").take(kept), pa.repeat(name, len(kept)), pa.array(found[kept])], ["_row", "macro_var", "rolling_corr"]))
        return pa.concat_tables(parts)

    schema = T.StructType([T.StructField("_row", kind), T.StructField("macro_var", T.StringType()), T.StructField("rolling_corr", T.DoubleType())])
    return narrow.groupBy(*keys).applyInArrow(correlate, schema).select("_row.*", "macro_var", "rolling_corr")


def rolling_correlation_summary(correlations: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    c = "rolling_corr"
    return correlations.groupBy(*keys, "macro_var").agg(
        F.round(F.avg(c), 4).alias("mean"),
        F.round(F.stddev_samp(c), 4).alias("std"),
        F.round(F.min(c), 4).alias("min"),
        F.round(F.max(c), 4).alias("max"),
    )


def _pair_sums(cell: pd.DataFrame) -> pd.DataFrame:
    """Joint sums for all series pairs of one (period, left block, right block) cell, by matrix products."""
    days, day_at = np.unique(cell["_day"].to_numpy(), return_inverse=True)
    sides = []
    for side in (0, 1):
        mine = (cell["_side"] == side).to_numpy()
        names, name_at = np.unique(cell["_key"].to_numpy()[mine].astype(str), return_inverse=True)
        present = np.zeros((len(days), len(names)))
        values = np.zeros((len(days), len(names)))
        present[day_at[mine], name_at] = 1.0
        values[day_at[mine], name_at] = cell["_value"].to_numpy()[mine]
        sides.append((names, present, values))
    (left, m1, v1), (right, m2, v2) = sides
    sums = [m1.T @ m2, v1.T @ m2, m1.T @ v2, (v1 * v1).T @ m2, m1.T @ (v2 * v2), v1.T @ v2]
    met = sums[0] > 0
    if cell["_same"].iloc[0]:
        met &= left[:, None] <= right[None, :]
    i, j = np.nonzero(met)
    out = {"left": left[i], "right": right[j]}
    out.update({name: s[i, j] for name, s in zip(("n", "x", "y", "xx", "yy", "xy"), sums, strict=True)})
    return pd.DataFrame(out)


def correlation_matrix(panel: DataFrame, value: str = "daily_return", key: str = "ticker") -> DataFrame:
    """Correlation of every pair of series over the days both have a value: (ticker_1, ticker_2, n, correlation).

    A self-join on the date would emit every pair on every day. Instead series are hashed into blocks, and each task
    multiplies two blocks of at most a year of days as matrices, so that only one row per pair and year is shuffled on
    to the final sum. A cell holds two blocks of about 256 series and 366 days, whatever the table size. Values are
    shifted by their series mean first, which leaves the result unchanged and the sums well conditioned.
    """
    # Repeated (day, series) rows are averaged, as in a pivot table.
    clean = (
        panel.where(F.col(value).isNotNull())
        .groupBy("date", F.col(key).alias("_key"))
        .agg(F.avg(value).alias("_value"))
    )
    # The number of series is counted without the values, so that only the key column is read for it.
    blocks = panel.select(
        F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(key) / SERIES_PER_BLOCK)).alias("_n")
    ).scalar()
    centred = (
        clean.withColumn("_value", F.col("_value") - F.avg("_value").over(W.partitionBy("_key")))
        .withColumn("_blocks", blocks)
        .withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))
    )
    # Block b is the left side of cells (b, j >= b) and the right side of cells (i <= b, b).
    cells = F.concat(
        F.transform(
            F.sequence(F.col("_block"), F.col("_blocks") - 1),
            lambda j: F.struct(F.lit(0).alias("side"), F.col("_block").alias("i"), j.alias("j")),
        ),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("_block")),
            lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.col("_block").alias("j")),
        ),
    )
    spread = centred.select(
        F.year("date").alias("_period"), F.unix_date("date").alias("_day"), "_key", "_value", F.explode(cells).alias("c")
    ).select(
        "_period", "_day", "_key", "_value", "c.i", "c.j", F.col("c.side").alias("_side"),
        (F.col("c.i") == F.col("c.j")).alias("_same"),
    )
    schema = "left string, right string, n double, x double, y double, xx double, yy double, xy double"
    partial = spread.groupBy("_period", "i", "j").applyInPandas(_pair_sums, schema)
    total = partial.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    spread_x = F.col("xx") - F.col("x") * F.col("x") / n
    spread_y = F.col("yy") - F.col("y") * F.col("y") / n
    joint = F.col("xy") - F.col("x") * F.col("y") / n
    # What is left of a constant series after subtracting its mean is rounding noise relative to its sum of squares.
    moving = (n >= 2) & (spread_x > F.col("xx") * 1e-12) & (spread_y > F.col("yy") * 1e-12)
    value_of = ratio(joint, F.sqrt(spread_x * spread_y))
    clamped = F.when(value_of > 1.0, 1.0).when(value_of < -1.0, -1.0).otherwise(value_of)
    measured = total.select(
        "left", "right", n.cast("bigint").alias("n"), F.when(moving, clamped).alias("correlation")
    )
    both_ways = F.when(
        F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")))
    ).otherwise(
        F.array(
            F.struct(F.col("left").alias("a"), F.col("right").alias("b")),
            F.struct(F.col("right").alias("a"), F.col("left").alias("b")),
        )
    )
    return measured.select(F.explode(both_ways).alias("p"), "n", "correlation").select(
        F.col("p.a").alias(f"{key}_1"), F.col("p.b").alias(f"{key}_2"), "n", "correlation"
    )
