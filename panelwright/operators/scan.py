"""Running values over series too long for one task: sums that fade, products, last known values.

``segments`` serves windows of bounded reach. A running value reaches back to the start of its series, so here each series
is cut into blocks by position, and three steps give every row its value:

1. every block is reduced to one row, what it hands on to the next block;
2. these rows are a series of their own, a block's length shorter, and are run over in the same way, down to few rows;
3. each block receives what all blocks before it hand on as one more row in front of its first, and runs over its rows.

Rows move by (key, block), so neither a hot key nor a long series ends up in one task, and no step depends on the number
of rows: every level divides it by the block's length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.segments import POSITION, by_segment, with_positions

Keys = Sequence[str]
BLOCK_ROWS = 10_000
#: Levels of blocks for values that do not fade: rows of a series divided by ``BLOCK_ROWS`` as many times.
LEVELS = 3
#: Weights within a block stay below ten to this power, and none below the other one counts, being lost in a double.
_DIGITS, _LOST = 250, 324
#: A value that fades within so many rows is added up from those rows alone.
_SHORT = 64


def _fading(decay: float) -> float:
    """Decimal digits lost per row."""
    return -math.log10(decay) if decay > 0 else math.inf


def _with_blocks(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumns({"_block": F.expr(f"{POSITION} div {size}"), "_slot": F.expr(f"{POSITION} % {size}")})


def _carried(after: DataFrame, keys: Keys, columns: Sequence[str], results: dict[str, str]) -> DataFrame:
    """What block b hands on, as a row in front of block b + 1."""
    return after.select(*keys, (F.col(POSITION) + 1).alias("_block"), F.lit(-1).cast("long").alias("_slot"), *[F.col(results[c]).alias(c) for c in columns])


def _run(rows: DataFrame, keys: Keys, columns: dict[str, str], decay: float, combine: str, size: int, levels: int) -> DataFrame:
    """``rows`` (keys, position, ...) with the running value of each of ``columns`` (input name -> output name)."""
    names = list(columns)
    if combine == "sum" and _LOST < _SHORT * _fading(decay):
        return _short(rows, keys, columns, decay)
    whole = W.partitionBy(*keys).orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)
    if not levels:
        return rows.withColumns({out: _over(c, POSITION, decay, combine, whole) for c, out in columns.items()})
    size = min(size, max(1, int(_DIGITS / _fading(decay)))) if decay < 1 else size
    blocked = _with_blocks(rows, size)
    handed = blocked.groupBy(*keys, "_block").agg(*[_total(c, size, decay, combine).alias(c) for c in names])
    after = _run(handed.withColumnRenamed("_block", POSITION), keys, columns, decay**size, combine, size, levels - 1 if decay == 1 else levels)
    both = blocked.unionByName(_carried(after, keys, names, columns), allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_block").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    done = both.withColumns({out: _over(c, "_slot", decay, combine, inside) for c, out in columns.items()})
    return done.where("_slot >= 0").drop("_block", "_slot")


def _total(column: str, size: int, decay: float, combine: str) -> Column:
    """A whole block's value at its last row."""
    if combine == "product":
        return F.product(F.coalesce(F.col(column), F.lit(1.0)))
    if combine == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_slot")))
    weight = F.lit(1.0) if decay == 1 else F.pow(F.lit(decay), F.lit(size - 1) - F.col("_slot"))
    return F.sum(F.coalesce(F.col(column), F.lit(0.0)) * weight)


def _over(column: str, slot: str, decay: float, combine: str, window) -> Column:
    if combine == "product":
        return F.product(F.coalesce(F.col(column), F.lit(1.0))).over(window)
    if combine == "last":
        return F.last(column, ignorenulls=True).over(window)
    value = F.coalesce(F.col(column), F.lit(0.0))
    if decay == 1:
        return F.sum(value).over(window)
    return F.sum(value * F.pow(F.lit(decay), -F.col(slot))).over(window) * F.pow(F.lit(decay), F.col(slot))


def _short(rows: DataFrame, keys: Keys, columns: dict[str, str], decay: float) -> DataFrame:
    """Each row's value goes to the few rows after it that it still counts for. For blocks' rows, which have no others."""
    reach = math.ceil(_LOST / _fading(decay)) if decay > 0 else 0
    spread = rows.select(*keys, POSITION, *columns, F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_ahead"))
    weight = F.pow(F.lit(decay), F.col("_ahead"))
    summed = [F.sum(F.coalesce(F.col(c), F.lit(0.0)) * weight).alias(out) for c, out in columns.items()]
    return spread.groupBy(*keys, (F.col(POSITION) + F.col("_ahead")).alias(POSITION)).agg(*summed)


def faded_sums(positioned: DataFrame, keys: Keys, columns: dict[str, str], decay: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per input column, y = decay * (y of the row before) + x, under the output's name; a null input counts as zero.

    ``positioned`` has 0-based positions without gaps (``with_positions``). 0 < decay <= 1; 1 gives running sums.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be above 0 and at most 1")
    if decay < 1 and _LOST < _SHORT * _fading(decay):
        # Too quick for blocks of rows: all of it lies within the reach of a segment.
        reach = math.ceil(_LOST / _fading(decay))

        def summed(frame: DataFrame, by: Keys) -> DataFrame:
            w = W.partitionBy(*by).orderBy(POSITION)
            terms = {c: [F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) * decay**k for k in range(reach + 1)] for c in columns}
            return frame.withColumns({out: sum(terms[c][1:], terms[c][0]) for c, out in columns.items()})

        return by_segment(positioned, summed, keys, back=reach)
    return _run(positioned, keys, columns, decay, "sum", block_rows, LEVELS)


def running_products(positioned: DataFrame, keys: Keys, columns: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Product of all rows up to each; a null factor counts as one."""
    return _run(positioned, keys, columns, 1.0, "product", block_rows, LEVELS)


def last_known(positioned: DataFrame, keys: Keys, columns: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The last value that is not null up to each row, of any type."""
    return _run(positioned, keys, columns, 1.0, "last", block_rows, LEVELS)


def previous(positioned: DataFrame, keys: Keys, columns: dict[str, str]) -> DataFrame:
    """The value of the row before, null on the first row of a series."""

    def lagged(frame: DataFrame, by: Keys) -> DataFrame:
        w = W.partitionBy(*by).orderBy(POSITION)
        return frame.withColumns({out: F.lag(c, 1).over(w) for c, out in columns.items()})

    return by_segment(positioned, lagged, keys, back=1)


def long_rsi(rows: DataFrame, keys: Keys, order: Keys, n: int, value: str = "close", column: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``signals.rsi`` for series of any length; ``order`` must be unique within a key."""
    moved = previous(with_positions(rows, keys, order), keys, {value: "_before"})
    change = F.col(value) - F.col("_before")
    inputs = moved.withColumns(
        {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0)), "_one": F.when(change.isNotNull(), 1.0)}
    )
    counted = faded_sums(inputs, keys, {"_one": "_known"}, 1.0, block_rows)
    means = faded_sums(counted, keys, {"_gain": "_up", "_loss": "_down"}, (n - 1) / n, block_rows)
    index = F.expr(
        f"""CASE WHEN _known < {n} THEN NULL
                 WHEN _down = 0 AND _up > 0 THEN 100D
                 WHEN _up = 0 AND _down > 0 THEN 0D
                 WHEN _up > 0 AND _down > 0 THEN 100D - 100D / (1D + _up / _down) END"""
    )
    return means.select(*rows.columns, index.alias(column or f"rsi_{n}"))


def compounded(rows: DataFrame, keys: Keys, order: Keys, columns: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Compounded return up to each row: the product of 1 + return over all rows so far, less 1; null returns count as 0."""
    inputs = with_positions(rows, keys, order).withColumns({f"_x{k}": F.lit(1.0) + F.col(c) for k, c in enumerate(columns)})
    done = running_products(inputs, keys, {f"_x{k}": f"_y{k}" for k in range(len(columns))}, block_rows)
    return done.select(*rows.columns, *[(F.col(f"_y{k}") - 1).alias(out) for k, out in enumerate(columns.values())])


def filled_forward(rows: DataFrame, keys: Keys, order: Keys, columns: Keys, limit: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nulls replaced by the last known value of the series, at most ``limit`` rows after it."""
    at = with_positions(rows, keys, order)
    known = at.withColumns({f"_k{k}": F.when(F.col(c).isNotNull(), F.struct(F.col(POSITION).alias("at"), F.col(c).alias("value"))) for k, c in enumerate(columns)})
    done = last_known(known, keys, {f"_k{k}": f"_l{k}" for k in range(len(columns))}, block_rows)

    def value(k: int) -> Column:
        near = F.lit(True) if limit is None else F.col(POSITION) - F.col(f"_l{k}.at") <= limit
        return F.when(near, F.col(f"_l{k}.value"))

    return done.withColumns({c: value(k) for k, c in enumerate(columns)}).select(*rows.columns)


def numbered_spells(rows: DataFrame, keys: Keys, order: Keys, state: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``regimes.spell_positions`` for series of any length: state_changed, spell (from 1) and spell_duration of each row."""
    moved = previous(with_positions(rows, keys, order), keys, {state: "_before"})
    first = (F.col(POSITION) == 0) | ~F.col(state).eqNullSafe(F.col("_before"))
    marked = moved.withColumns({"_changed": F.when(first, 1.0).otherwise(0.0), "_start": F.when(first, F.col(POSITION))})
    counted = faded_sums(marked, keys, {"_changed": "_spell"}, 1.0, block_rows)
    begun = last_known(counted, keys, {"_start": "_begun"}, block_rows)
    return begun.select(
        *rows.columns,
        F.col("_changed").cast("int").alias("state_changed"),
        F.col("_spell").cast("long").alias("spell"),
        (F.col(POSITION) - F.col("_begun") + 1).alias("spell_duration"),
    )


def long_spells(rows: DataFrame, keys: Keys, order: Keys, state: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per uninterrupted run of a state: keys, state, start and end in ``order[0]``, rows. Rows without state are left out."""
    known = rows.where(F.col(state).isNotNull())
    at = order[0]
    return (
        numbered_spells(known, keys, order, state, block_rows)
        .groupBy(*keys, "spell")
        .agg(F.first(state).alias(state), F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n_rows"))
    )


def asof_ordered(left: DataFrame, right: DataFrame, on: str, by: Keys = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Attach to each left row the latest right row with ``on`` at or before its own, for keys of any resolution.

    Both sides are one series per ``by``, right rows before left ones of the same moment; the last right row is carried
    along it, over the borders of tasks. As in ``asof.asof_backward``: the whole right row is taken even where its values
    are NULL, of equal moments the greatest row, and left rows before the first reading, or without a moment, get NULLs.
    """
    by = list(by)
    carried = [c for c in right.columns if c != on and c not in by]
    readings = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*carried)).alias("_row"))
    # Left rows of one moment need an order: any will do, as all get the same reading.
    sided = left.where(F.col(on).isNotNull()).select(
        *by, on, F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_tie"), F.struct(*left.columns).alias("_left")
    )
    both = sided.unionByName(readings.withColumns({"_side": F.lit(0), "_tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    done = last_known(with_positions(both, by, [on, "_side", "_tie"]), by, {"_row": "_last"}, block_rows)
    found = done.where("_side = 1").select("_left.*", *[F.col("_last")[c].alias(c) for c in carried])
    without = left.where(F.col(on).isNull())
    return found.unionByName(without.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in carried]))


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float], keys: Keys = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, share, value): quantiles by linear interpolation between ranks, exact at any number of rows.

    Equal values become one row with their number, which combines before the shuffle. Those rows are range-partitioned and
    their numbers run over, so each knows the ranks it covers; a quantile lies between the values of two ranks. No task sees
    more than its range, and none keeps a table of values. Nulls are left out; a key without values has no rows.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_value")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    upto = faded_sums(with_positions(counted, keys, ["_value"]), keys, {"_n": "_upto"}, 1.0, block_rows)
    sizes = counted.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys]).agg(F.sum("_n").alias("_all"))
    ranks = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: F.struct(s.alias("share"), (s * (F.col("_all") - 1)).alias("rank")))
    sizes = sizes.withColumn("_ranks", ranks)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    placed = upto.join(sizes, same) if keys else upto.crossJoin(F.broadcast(sizes))  # one row
    low, high = F.col("_upto") - F.col("_n"), F.col("_upto")
    met = F.filter("_ranks", lambda r: (F.ceil(r["rank"]) >= low) & (F.floor(r["rank"]) < high))
    near = placed.withColumn("_met", F.explode(met)).select(*keys, "_value", "_met.*", low.alias("_low"), high.alias("_high"))
    part = F.col("rank") - F.floor("rank")
    below = (F.floor("rank") >= F.col("_low")) & (F.floor("rank") < F.col("_high"))
    above = (F.ceil("rank") >= F.col("_low")) & (F.ceil("rank") < F.col("_high"))
    return near.groupBy(*keys, "share").agg(
        (F.max(F.when(below, F.col("_value"))) + F.max(F.when(below, part)) * (F.max(F.when(above, F.col("_value"))) - F.max(F.when(below, F.col("_value"))))).alias("value")
    )
