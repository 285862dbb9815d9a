"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source's documents, in an order that a hash fixes, form blocks. A source of weight w (slots out of a period) releases
its k-th block at slot floor((k-1)/w) and must place it before slot ceil(k/w); every slot goes to the released block of
the earliest deadline. After any number of slots each source then has less than one block more or less than its share.
The schedule repeats with the period, so one period is computed, by a fold over its slots, and blocks join it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import cut

#: State of the fold: blocks placed so far by source, and the source of every slot. `s` holds the sources' slots a period.
_NEXT_SLOT = """
(a, t) -> transform(
    array(array_min(filter(
        transform(s, (x, i) -> IF((a.k[i] * q) DIV x.slots <= t,
                                  struct(((a.k[i] + 1) * q + x.slots - 1) DIV x.slots AS deadline, i AS i), NULL)),
        y -> y IS NOT NULL)).i),
    b -> struct(transform(a.k, (v, i) -> v + IF(i = b, 1L, 0L)) AS k, concat(a.picks, array(b)) AS picks))[0]
"""


def _source_key(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def slots_per_period(sizes: DataFrame, weights: DataFrame | None, resolution: int, power: float) -> DataFrame:
    """(_source, slots): each source's slots of a period of about ``resolution`` slots, at least one.

    ``sizes`` has _source and n. Without ``weights`` (source, weight) a source weighs n to the ``power``.
    """
    if weights is None:
        weighed = sizes.select("_source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w"))
    else:
        given = weights.select(_source_key("source").alias("_source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
        given = given.groupBy("_source").agg(F.max("w").alias("w"))
        weighed = sizes.join(given, "_source", "left").select("_source", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = F.sum("w").over(Window.partitionBy())  # one row a source
    share = F.coalesce(F.try_divide("w", total), F.lit(0.0))
    return weighed.select("_source", F.greatest(F.lit(1), F.floor(share * resolution + 0.5)).cast("long").alias("slots"))


def period_pattern(slots: DataFrame) -> DataFrame:
    """(_source, slots, period, turn, slot): the slot of each source's turn-th block (from 0) of a period."""
    row = slots.agg(F.array_sort(F.collect_list(F.struct("_source", "slots"))).alias("s"), F.sum("slots").alias("q"))
    fold = f"aggregate(sequence(0L, q - 1), struct(transform(s, x -> 0L) AS k, array_repeat(0, 0) AS picks), {_NEXT_SLOT}, a -> a.picks)"
    picked = row.where("q > 0").select("s", "q", F.posexplode(F.expr(fold)).alias("slot", "pick"))
    picked = picked.selectExpr("s[pick]._source AS _source", "s[pick].slots AS slots", "q AS period", "cast(slot AS long) AS slot")
    turn = F.row_number().over(Window.partitionBy("_source").orderBy("slot")) - 1
    return picked.withColumn("turn", turn.cast("long"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block_rows: int = 64,
    resolution: int = 1000,
    power: float = 0.5,
    rows_per_bucket: int = 50_000,
    max_sources: int = 10_000,
) -> DataFrame:
    """``docs`` (doc_id, source) with block (from 1), slot and position: reading by position gives the mix.

    No row is left out. When a source has run out its slots stay empty and the others go on in proportion. position is
    slot * block_rows + place in the block, so it has gaps. Null source is a source of its own; null doc_id sorts first.
    Within a source, rows are ordered by the MD5 of doc_id, then doc_id; repeated rows come next to each other. A source without a weight, or
    with one of zero or less, gets one slot a period; so does one whose share is under half a slot. An empty table gives an
    empty one. Existing columns block, slot and position are replaced.

    Rows of a source are numbered without gathering it: they are cut by their hash into buckets of about
    ``rows_per_bucket`` rows, numbered within a bucket, and moved up by the sizes of the buckets before. The broadcast pattern
    has at most ``resolution + 2 * max_sources`` rows; more sources raise an error.
    """
    base = docs.drop("block", "slot", "position")
    buckets = max(1, -(-base.count() // rows_per_bucket))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    top = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    keyed = base.withColumns({"_source": _source_key("source"), "_order": order})
    keyed = keyed.withColumn("_bucket", (top * F.lit(buckets) / F.lit(float(1 << 32))).cast("long"))
    counts = keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")
    starts = counts.select("_source", "_bucket", before.alias("_before"))
    sizes = counts.groupBy("_source").agg(F.sum("_n").alias("n"))
    if sizes.limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = {c: f"_{c}" for c in ("slots", "period", "turn", "slot")}
    pattern = cut(period_pattern(slots_per_period(sizes, weights, resolution, power)).withColumnsRenamed(names))
    place = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id"))
    numbered = keyed.withColumn("_place", place).join(starts, ["_source", "_bucket"])
    numbered = numbered.withColumn("_row", F.col("_before") + F.col("_place") - 1)
    numbered = numbered.withColumn("block", F.expr(f"_row DIV {block_rows}"))
    out = _placed(numbered, pattern, block_rows)
    return out.select(*base.columns, "block", "slot", "position")


def _placed(numbered: DataFrame, pattern: DataFrame, block_rows: int) -> DataFrame:
    slots = F.broadcast(pattern.select("_source", "_slots", "_period").distinct())
    turned = numbered.join(slots, "_source").withColumn("_turn", F.col("block") % F.col("_slots"))
    out = turned.join(F.broadcast(pattern.select("_source", "_turn", "_slot")), ["_source", "_turn"])
    slot = F.expr("block DIV _slots") * F.col("_period") + F.col("_slot")
    out = out.withColumn("slot", slot).withColumn("position", F.col("slot") * block_rows + F.col("_row") % block_rows)
    return out.withColumn("block", F.col("block") + 1)
