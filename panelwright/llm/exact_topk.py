"""Exact largest inner products with a pivot-distance index.

One more component, sqrt(M^2 - |x|^2) for the largest norm M, puts all vectors on a sphere; the squared distance to a query
(0 there) is then |q|^2 + M^2 - 2 q.x, so the nearest vectors have the largest inner products. Vectors are keyed by nearest
pivot and distance to it. A query first looks into its own annulus; the k-th best score found bounds the distance D that
can still matter, and by the triangle inequality only annuli between d(q, pivot) - D and d(q, pivot) + D are left. They are
visited from near to far, with a smaller D after every step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import skew_join, written


def whole_vectors(vectors: DataFrame, scaled: Column) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null vectors and those with null or non-finite components.

    Rows without vec_id take no part; rows that repeat one all do.
    """
    limit = F.lit(float("inf"))
    ok = F.forall("v", lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of the list column, shorter ones filled with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _keyed(data: DataFrame, pivots: np.ndarray, top: float, width: int, step: float) -> DataFrame:
    """(vec_id, v, pivot, distance, ring) by the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lifted(_matrix(batch.column("v"), width), top)
            d = _distances(x, pivots)
            near = d.argmin(1)
            r = d[np.arange(len(x)), near]
            ring = np.floor(r / step).astype(np.int32)
            columns = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(r), pa.array(ring)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "pivot", "distance", "ring"])

    return data.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, pivot int, distance double, ring int")


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def _packed(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """One row per key: ids and vectors as bytes, least and greatest distance. Keys have at most a few hundred rows."""
    fields = F.struct("vec_id", "distance", "v")
    grouped = rows.groupBy(*key).agg(F.sort_array(F.collect_list(fields)).alias("r"))
    flat = grouped.select(*key, F.col("r.vec_id").alias("ids"), F.col("r.distance").alias("d"), F.col("r.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x, "<i8").tobytes() for x in batch.column("ids").to_pylist()]
            d = batch.column("d").to_pylist()
            data = []
            for k in range(batch.num_rows):
                data.append(_matrix(batch.column("v")[k].values, width).tobytes())
            low, high = [min(x) for x in d], [max(x) for x in d]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in key), pa.array(ids), pa.array(data), pa.array(low), pa.array(high)], [*key, "ids", "data", "low", "high"]
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return flat.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in key) + ", ids binary, data binary, low double, high double")


def _scored(visits: DataFrame, pivots: np.ndarray, top: float, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each visited cell, a query's k best that reach its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_out, x_out, s_out = [], [], []
            for row in batch.to_pylist():
                qid, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_data"]).reshape(-1, width)
                xid, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"]).reshape(-1, width)
                bound = np.full(len(qid), -np.inf)
                if row["bounds"]:
                    known = {b["query_id"]: b["bound"] for b in row["bounds"]}
                    bound = np.array([known.get(i, -np.inf) for i in qid.tolist()])
                far = (q * q).sum(1) + top - 2 * bound
                reach = np.sqrt(np.maximum(0, far)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top))
                d = _distances(np.column_stack((q, np.zeros(len(q)))), pivots[row["pivot"]][None])[:, 0]
                near = np.maximum(d - row["high"], row["low"] - d)
                live = np.flatnonzero((bound == -np.inf) | (near <= reach))
                if not len(live):
                    continue
                score = q[live] @ x.T
                score[qid[live][:, None] == xid] = -np.inf
                for j, s in zip(live, score):
                    fit = np.flatnonzero((s >= bound[j]) & (s > -np.inf))
                    if len(fit) > k:
                        fit = fit[s[fit] >= np.partition(s[fit], -k)[-k]]
                        fit = fit[np.lexsort((xid[fit], -s[fit]))[:k]]
                    q_out.append(np.full(len(fit), qid[j]))
                    x_out.append(xid[fit])
                    s_out.append(s[fit].astype(np.int64))
            empty = np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate(c or [empty]), pa.int64()) for c in (q_out, x_out, s_out)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    needed = visits.select("q_ids", "q_data", "bounds", "pivot", "ids", "data", "low", "high")
    return needed.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, pivots: int = 64, rings: int = 64, cell_rows: int = 512, seed: int = 3
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with all other rows.

    ``vectors`` is (vec_id, v) of whole numbers as doubles, from ``whole_vectors``; ``queries`` says which rows are queries.
    Rows that repeat a vec_id are rows of their own: each is a candidate of the others, and a query if its id is one. Ties go
    to the smaller vec_id; fewer than ``k`` others give fewer rows; an empty table gives none. Vectors shorter than the longest count
    as filled with zeros. Scores are exact while they stay below 2^53.

    ``pivots`` vectors at most (fewer for small tables) are the bounded sample that the index is fitted to; every row is indexed. Cells hold about ``cell_rows`` rows: a
    crowded annulus, also one of equal vectors, is several cells. Queries are visited in blocks of one pivot and ring.
    """
    # Rows are told apart by a number that grows with vec_id, so that ties by number are ties by vec_id.
    order = ["vec_id", F.xxhash64("v")]
    numbered = vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    numbered = written(numbered, "topk-vectors")
    ids = numbered.select("row", "vec_id")
    asking = numbered.where(queries).select(F.col("row").alias("vec_id"))
    data = numbered.select(F.col("row").alias("vec_id"), "v")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("top")).first()
    if not size["n"]:
        return ids.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "vec_id AS score").limit(0)
    width, top = max(1, size["width"]), float(size["top"])
    pivots = int(np.clip(size["n"] // (4 * cell_rows), 4, pivots))
    chosen = data.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(pivots).select("v").collect()
    centres = _lifted(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in chosen]), top)
    step = max(1e-9, 2 * np.sqrt(top)) / rings  # no two vectors are further apart than 2 M
    keyed = written(_keyed(data, centres, top, width, step), "topk-keys")
    sizes = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
    split = keyed.join(F.broadcast(sizes), ["pivot", "ring"])  # at most pivots * rings rows
    split = split.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    cells = written(_packed(split, ["pivot", "ring", "part"], width), "topk-cells")

    asked = keyed.join(asking, "vec_id", "left_semi")
    asked = asked.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("parts") / 8))).cast("int"))
    blocks = _packed(asked.drop("parts"), ["pivot", "ring", "part"], width)
    blocks = blocks.select(
        F.concat_ws("-", "pivot", "ring", "part").alias("block"), F.col("pivot").alias("home"), F.col("ring").alias("home_ring"),
        F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
    )
    blocks = written(blocks, "topk-queries")
    none = F.array().cast("array<struct<query_id:bigint,bound:double>>")
    seen = blocks.selectExpr("block", "home AS pivot", "home_ring AS ring")
    best = _best(_scored(_visits(blocks.withColumn("bounds", none), seen, cells), centres, top, width, k), None, k)
    for share in (0.5, 1.0):
        bounded = _bounded(blocks, best, k)
        wanted = _reach(bounded, centres, top, width, step, rings, share)
        new = written(wanted.join(seen, ["block", "pivot", "ring"], "left_anti"), "topk-visits")
        seen = seen.union(new)
        best = _best(_scored(_visits(bounded, new, cells), centres, top, width, k), best, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", place).withColumnsRenamed({"query_id": "query_row", "vec_id": "row"})
    named = ranked.join(ids, "row").select(F.col("query_row").alias("row"), "rank", F.col("vec_id").alias("found"), "score")
    return named.join(ids, "row").select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def _visits(blocks: DataFrame, wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Query blocks go to the cells, which stay where their annulus is."""
    return skew_join(cells, skew_join(wanted, blocks.drop("home", "home_ring"), ["block"]), ["pivot", "ring"])


def _best(scored: DataFrame, before: DataFrame | None, k: int) -> DataFrame:
    rows = scored if before is None else scored.union(before)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return written(rows.withColumn("place", place).where(F.col("place") <= k).drop("place"), "topk-best")


def _bounded(blocks: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Blocks with the k-th best score so far of their queries (none with fewer than k)."""
    bounds = best.groupBy("query_id").agg(F.min("score").cast("double").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(b, i) for b, raw in zip(batch.column("block").to_pylist(), batch.column("q_ids").to_pylist()) for i in np.frombuffer(raw, "<i8").tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["block", "query_id"]
            )

    members = blocks.select("block", "q_ids").mapInArrow(ids, "block string, query_id long")
    per_block = members.join(bounds, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "bound")).alias("bounds"))
    return written(blocks.join(per_block, "block", "left"), "topk-bounds")


def _reach(bounded: DataFrame, pivots: np.ndarray, top: float, width: int, step: float, rings: int, share: float) -> DataFrame:
    """(block, pivot, ring): annuli within ``share`` of the distance that can still matter to a query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_data"]).reshape(-1, width)
                known = {b["query_id"]: b["bound"] for b in row["bounds"] or []}
                bound = np.array([known.get(i, -np.inf) for i in np.frombuffer(row["q_ids"], "<i8").tolist()])
                reach = np.sqrt(np.maximum(0, (q * q).sum(1) + top - 2 * np.maximum(bound, -1e300))) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top))
                d = _distances(np.column_stack((q, np.zeros(len(q)))), pivots)
                low = np.floor((d - share * reach[:, None]).min(0) / step).clip(0, rings)
                high = np.floor((d + share * reach[:, None]).max(0) / step).clip(-1, rings)
                out += [(row["block"], p, r) for p in range(len(pivots)) for r in range(int(low[p]), int(high[p]) + 1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "pivot", "ring"])

    return bounded.select("block", "q_ids", "q_data", "bounds").mapInArrow(run, "block string, pivot int, ring int")
