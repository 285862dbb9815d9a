"""Trailing windows of many rows at constant cost per row.

A sliding frame aggregates all its rows again for every row. Here each series is cut into blocks as long as the window.
The window ending at a row is then the end of the previous block plus the start of the current one, and both parts come
from running aggregates: forwards inside the block, and backwards inside the block, looked up one window length earlier.
Nothing is subtracted, so it works for minima and maxima and loses no precision for sums. All steps share one hash
partitioning by series.

Aggregates and results are SQL text, since they are generated in numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.guarded import series_window

HEAD, TAIL = "_head", "_tail"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def with_window_parts(
    df: DataFrame, aggregates: Mapping[str, str], rows: int, keys: Sequence[str], order: str = "date"
) -> DataFrame:
    """Add structs ``_head`` (current block) and ``_tail`` (previous block, or NULL) that together cover the window."""
    at = F.row_number().over(series_window(keys, order)) - 1
    placed = df.withColumn("_at", at).withColumns(
        {"_block": F.expr(f"_at div {rows}"), "_slot": F.expr(f"_at % {rows}")}
    )
    block = ", ".join(f"`{k}`" for k in [*keys, "_block"])

    def running(direction: str) -> Column:
        over = f"OVER (PARTITION BY {block} ORDER BY _slot {direction} {RUNNING})"
        return F.expr("named_struct(" + ", ".join(f"'{n}', {a} {over}" for n, a in aggregates.items()) + ")")

    along = W.partitionBy(*keys).orderBy("_block", "_slot")
    parts = placed.withColumn("_back", running("DESC")).withColumn(HEAD, running("ASC"))
    # On the last slot the block is the whole window.
    earlier = F.when(F.col("_slot") < rows - 1, F.lag("_back", rows - 1).over(along))
    return parts.withColumn(TAIL, earlier).select(*df.columns, HEAD, TAIL)


def window_total(name: str) -> str:
    return f"(coalesce(_head.{name}, 0) + coalesce(_tail.{name}, 0))"


def window_max(name: str) -> str:
    return f"greatest(_head.{name}, _tail.{name})"


def window_min(name: str) -> str:
    return f"least(_head.{name}, _tail.{name})"
