"""Row-position windows over series too long for one task.

A plain ``Window.partitionBy(key)`` gives one key to one task. That is fine for daily panels: with at most one row per
(key, day), a key never holds more rows than the calendar has days. For series ordered by anything finer (timestamps,
sequence numbers) a single key, or a single moment of it, may hold a large share of the table. These helpers cut each
series into segments of a fixed number of rows and hand every segment the few rows before and after it that its windows
reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.lineage import keep_for_reuse

POSITION = "_position"
SEGMENT = "_segment"


def with_positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the 0-based position of each row within its series, without gathering a series anywhere.

    Rows are range-partitioned by (key, order), which splits a long series, or a burst within it, over as many
    partitions as it fills. Inside a sorted partition the running row id counts the rows; the offset of a partition
    comes from the sizes of the earlier partitions of the same key. ``order`` must be unique within a key.

    Range bounds come from a sample, so the sorted rows are kept (see ``keep_for_reuse``): both uses below must see the
    same partitions.
    """
    by_range = [F.col(c) for c in (*keys, *order)]
    ranged = rows.repartitionByRange(*by_range).sortWithinPartitions(*by_range)
    tagged = keep_for_reuse(ranged.withColumn("_id", F.monotonically_increasing_id()))
    # The upper bits of the id are the partition, the lower 33 the row within it.
    part = F.shiftrightunsigned("_id", 33)
    sizes = tagged.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], part.alias("_part")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    earlier = W.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    same = part == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return tagged.join(offsets, same).select(
        *rows.columns, (F.col("_offset") + F.col("_id") - F.col("_first")).alias(POSITION)
    )


def in_segments(
    rows: DataFrame,
    transform: Callable[[DataFrame, Sequence[str]], DataFrame],
    keys: Sequence[str],
    order: Sequence[str],
    back: int = 0,
    ahead: int = 0,
    rows_per_segment: int = 100_000,
) -> DataFrame:
    """Apply ``transform(frame, keys)`` segment by segment, with the same result as on whole series.

    ``transform`` may look at most ``back`` rows behind and ``ahead`` rows in front of each row, and must keep one
    output row per input row. A segment never holds more than ``rows_per_segment + back + ahead`` rows.
    """
    return by_segment(with_positions(rows, keys, order), transform, keys, back, ahead, rows_per_segment).drop(POSITION)


def by_segment(
    positioned: DataFrame,
    transform: Callable[[DataFrame, Sequence[str]], DataFrame],
    keys: Sequence[str],
    back: int = 0,
    ahead: int = 0,
    rows_per_segment: int = 100_000,
) -> DataFrame:
    """``in_segments`` for rows that have their positions already, and keep them."""
    size = F.lit(rows_per_segment)
    position = F.col(POSITION)
    first = F.floor((position - ahead) / size)
    last = F.floor((position + back) / size)
    spread = positioned.withColumn(SEGMENT, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    done = transform(spread, [*keys, SEGMENT])
    return done.where(F.floor(position / size) == F.col(SEGMENT)).drop(SEGMENT)
