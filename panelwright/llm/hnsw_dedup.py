"""Near-duplicate vectors with hierarchical navigable small-world graphs, one per shard.

Every shard's vectors are linked to near ones, chosen to lie in different directions, on levels of falling size. All
vectors are asked of every shard's graph: from the best node of the top level down, then with a beam on the ground level.
A beam that is full of links is widened until it sees past them, and beams are widened further until an audit against
brute force finds enough links. Found pairs are verified in double precision; their components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import components, skew_join, written

#: Nodes handled at once, for bounded memory.
_ROWS = 256


def _select(x: np.ndarray, near: np.ndarray, sim: np.ndarray, keep: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those nearer to it than to any one taken before; then the nearest others."""
    n, c = near.shape
    taken = np.zeros((n, c), bool)
    for j in range(c):
        between = np.einsum("nd,ncd->nc", x[near[:, j]], x[near[:, :j]]) if j else np.zeros((n, 0), x.dtype)
        blocked = (taken[:, :j] & (between > sim[:, j : j + 1])).any(1)
        taken[:, j] = ~blocked & (taken.sum(1) < keep)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(near, order, 1)


def build_graph(x: np.ndarray, keep: int, candidates: int) -> np.ndarray:
    """Links (n x 2 keep, -1 for none) over unit vectors: ``keep`` chosen ones and the reverse of others'."""
    n = len(x)
    if n == 1:
        return np.full((1, 2 * keep), -1, np.int32)
    c = min(candidates, n - 1)
    chosen = []
    for start in range(0, n, _ROWS):
        sim = x[start : start + _ROWS] @ x.T
        sim[np.arange(len(sim)), np.arange(start, start + len(sim))] = -2
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        chosen.append(_select(x, near, np.take_along_axis(sim, near, 1), min(keep, c)))
    out = np.full((n, 2 * keep), -1, np.int32)
    own = np.concatenate(chosen).astype(np.int32)
    out[:, : own.shape[1]] = own
    # Reverse links fill what is left, in a fixed but scattered order.
    to, of = own.ravel(), np.repeat(np.arange(n, dtype=np.int32), own.shape[1])
    mix = np.random.default_rng(1).permutation(len(to))
    to, of = to[mix], of[mix]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    fits = rank < 2 * keep - own.shape[1]
    out[to[fits], own.shape[1] + rank[fits]] = of[fits]
    return out


def beam_search(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``width`` best nodes met from ``entry`` (q x e), -1 and -2 where there are fewer."""
    b, n = len(q), len(x)
    width = max(width, entry.shape[1])
    seen = np.zeros((b, n), bool)
    ids = np.full((b, width), -1, np.int64)
    sims = np.full((b, width), -2, x.dtype)
    done = np.ones((b, width), bool)
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.einsum("bd,bed->be", q, x[entry])
    done[:, : entry.shape[1]] = False
    np.put_along_axis(seen, entry, True, 1)
    # Queries leave when none of their nodes is open; what is kept of those that go on is moved together then.
    live, asked, met = np.arange(b), q, seen.ravel()
    now = [ids, sims, done]
    while True:
        open_sims = np.where(now[2], -3, now[1])
        goes_on = open_sims.max(1) > -3
        if not goes_on.all():
            for whole, part in zip((ids, sims, done), now):
                whole[live] = part
            live, asked, open_sims, now = live[goes_on], asked[goes_on], open_sims[goes_on], [part[goes_on] for part in now]
        if not len(live):
            return ids, sims
        pick = np.argsort(-open_sims, axis=1, kind="stable")[:, :step]
        use = np.take_along_axis(open_sims, pick, 1) > -3
        at = np.arange(len(live))[:, None]
        now[2][at, pick] |= use
        nodes = np.where(use, now[0][at, pick], -1)
        near = links.take(nodes, 0)
        near[nodes < 0] = -1
        near = near.reshape(len(live), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        spots = np.flatnonzero(fresh)
        r = spots // near.shape[1]
        place = live[r] * n + near.ravel()[spots]
        new = ~met[place]
        spots, r, place = spots[new], r[new], place[new]
        met[place] = True
        # What is new to each query, moved to the left of its row.
        counts = np.bincount(r, minlength=len(live))
        column = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = near.ravel()[spots]
        more = int(counts.max()) if len(r) else 0
        new_ids, new_sims, new_done = np.full((len(live), more), -1, np.int64), np.full((len(live), more), -2, x.dtype), np.ones((len(live), more), bool)
        new_ids[r, column] = found
        new_sims[r, column] = np.einsum("nd,nd->n", np.repeat(asked, counts, 0), x.take(found, 0))
        new_done[r, column] = False
        now = [np.concatenate(pair, 1) for pair in zip(now, (new_ids, new_sims, new_done))]
        if more:
            best = np.argpartition(-now[1], width - 1, axis=1)[:, :width]
            now = [part[at, best] for part in now]


def range_search(q: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], least: float, width: int, entry: np.ndarray | None) -> list[np.ndarray]:
    """Per query, the nodes of similarity ``least`` or more that the graph shows. ``levels``: (nodes, links), ground first."""
    out: list[np.ndarray] = []
    for start in range(0, len(q), _ROWS):
        part = q[start : start + _ROWS]
        top_nodes, _ = levels[-1]
        at = top_nodes[(part @ x[top_nodes].T).argmax(1)][:, None]
        for nodes, links in reversed(levels[1:-1]):
            local = np.searchsorted(nodes, at)
            ids, sims = beam_search(part, x[nodes], links, local, 8)
            at = nodes[np.take_along_axis(ids, sims.argmax(1)[:, None], 1)]
        if entry is not None:
            at = np.concatenate((at, entry[start : start + _ROWS, None]), 1)
            at[at[:, 0] == at[:, 1], 0] = (at[at[:, 0] == at[:, 1], 0] + 1) % len(x)
        at = at[:, : len(x)]
        rows, beam = np.arange(len(part)), min(width, len(x))
        hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(part)
        while len(rows):
            ids, sims = beam_search(part[rows], x, levels[0][1], at[rows], beam)
            full = sims.min(1) >= least
            for k in np.flatnonzero(~full | (beam >= len(x))):
                hits[rows[k]] = ids[k][sims[k] >= least]
            rows = rows[full] if beam < len(x) else rows[:0]
            beam = min(len(x), 2 * beam)
        out += hits
    return out


def _graphs(vectors: DataFrame, keep: int, candidates: int, ratio: int) -> DataFrame:
    """(shard, ids, weights, data, width, levels): one row per shard."""
    schema = "shard string, ids binary, weights binary, data binary, width int, links binary"

    def run(table: pa.Table) -> pa.Table:
        width = len(table.column("v")[0])
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        data = np.array(table.column("v").to_pylist(), np.float64).reshape(-1, width)[order]
        x = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)
        return pa.Table.from_pydict(
            {
                "shard": table.column("shard").slice(0, 1),
                "ids": [ids[order].astype("<i8").tobytes()],
                "weights": [table.column("n").to_numpy()[order].astype("<i8").tobytes()],
                "data": [data.tobytes()],
                "width": pa.array([width], pa.int32()),
                "links": [build_graph(x, keep, candidates).tobytes()],
            }
        )

    return vectors.groupBy("shard").applyInArrow(run, schema)


def _levels(x: np.ndarray, links: np.ndarray, ratio: int, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ground level and the smaller ones above: every ratio-th, ratio^2-th ... node of a fixed random order."""
    order = np.random.default_rng(2).permutation(len(x))
    levels = [(np.arange(len(x)), links)]
    size = len(x) // ratio
    while size > ratio:
        nodes = np.sort(order[:size])
        levels.append((nodes, build_graph(x[nodes], keep, 2 * keep)))
        size //= ratio
    levels.append((np.sort(order[: max(1, size)]), None))
    return levels


def _find(pairs: DataFrame, threshold: float, beam: int, keep: int, ratio: int, audit: int, recall: float) -> DataFrame:
    """(id, links, root): per task and vector the weight of its links found there and the smallest id they connect it to."""

    def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        root = np.arange(n)
        while True:
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                return root

    def links_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        q, x = np.frombuffer(row["q_data"]).reshape(len(q_ids), -1), np.frombuffer(row["data"]).reshape(len(x_ids), -1)
        q, x = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
        small_q, small_x = q.astype(np.float32), x.astype(np.float32)
        levels = _levels(small_x, np.frombuffer(row["links"], "<i4").reshape(len(x), -1), ratio, keep)
        same = row["q_shard"] == row["shard"]
        entry = np.arange(len(q)) if same else None
        width = beam
        while True:
            hits = range_search(small_q, small_x, levels, threshold - 1e-5, width, entry)
            some = np.flatnonzero([len(h) > same for h in hits])
            checked = np.unique(np.concatenate((some[:audit], np.linspace(0, len(q) - 1, audit).astype(np.int64))))
            truth = small_q[checked] @ small_x.T >= threshold
            found = sum(truth[k, hits[i]].sum() for k, i in enumerate(checked))
            if found >= recall * truth.sum() or width >= len(x):
                break
            width = min(len(x), 2 * width)
        a = np.repeat(np.arange(len(q)), [len(h) for h in hits])
        b = np.concatenate(hits) if len(hits) else np.zeros(0, np.int64)
        if same:  # found from either end
            low, high = np.minimum(a, b), np.maximum(a, b)
            code = np.unique(low[low < high] * len(x) + high[low < high])
            a, b = code // len(x), code % len(x)
        cosine = np.concatenate([np.einsum("nd,nd->n", q[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
        return a[cosine >= threshold], b[cosine >= threshold], same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, same = links_of(row)
                q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q_n, x_n = np.frombuffer(row["q_weights"], "<i8"), np.frombuffer(row["weights"], "<i8")
                ids = np.unique(np.concatenate((q_ids[a], x_ids[b])))
                left, right = np.searchsorted(ids, q_ids[a]), np.searchsorted(ids, x_ids[b])
                count = np.bincount(left, x_n[b], len(ids)) + np.bincount(right, q_n[a], len(ids))
                root = ids[forest(left, right, len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(count.astype(np.int64)), pa.array(root, pa.int64())], ["id", "links", "root"]
                )

    return pairs.mapInArrow(run, "id long, links long, root long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    shard_rows: int = 8192,
    keep: int = 16,
    candidates: int = 48,
    ratio: int = 16,
    beam: int = 32,
    audit: int = 64,
    recall: float = 0.98,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of ``threshold`` or more, in double precision; those that are null, zero, of no components or hold
    null or non-finite ones link with nothing, and vectors of different length never link. Equal vectors are one node with
    a weight, so their graph cannot clog. Rows that repeat a vec_id are vectors like others, and share the component; rows
    with null vec_id get null component, no links, and are kept.

    Each pair of shards is one task, which holds two shards of about ``shard_rows`` vectors and sends one row per linked vector;
    pairs of vectors never leave it. ``audit`` queries of a task, those with links first, are held against brute force; beams
    double until ``recall`` of their links is found.
    """
    limit = F.lit(float("inf"))
    ok = F.forall("v", lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("node", F.when(usable, F.struct(F.xxhash64("v"), F.hash("v"))).cast("struct<a:bigint,b:int>"))
    nodes = marked.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("v").alias("v"))
    nodes = written(nodes, "vector-nodes")
    shards = nodes.groupBy(F.size("v").alias("width")).agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    shards = written(shards, "vector-shards")
    number = F.pmod(F.xxhash64("id"), F.col("shards"))
    placed = nodes.withColumn("width", F.size("v")).join(shards, "width").select(F.concat_ws("-", "width", number).alias("shard"), "id", "n", "v")
    graphs = written(_graphs(placed, keep, candidates, ratio), "vector-graphs")
    asked = shards.select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("i"), "shards")
    asked = asked.select("width", "i", F.explode(F.sequence("i", F.col("shards") - 1)).alias("j"))
    asked = asked.select(F.concat_ws("-", "width", "i").alias("q_shard"), F.concat_ws("-", "width", "j").alias("shard"))
    queries = graphs.selectExpr("shard AS q_shard", "ids AS q_ids", "weights AS q_weights", "data AS q_data")
    pairs = asked.join(queries, "q_shard").join(graphs, "shard").repartition("q_shard", "shard")
    found = written(_find(pairs, threshold, beam, keep, ratio, audit, recall), "vector-links")
    classes = components(found.where("id != root").selectExpr("id AS a", "root AS b"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = nodes.select("node", "id", "n").join(counts, "id", "left").join(classes, "id", "left")
    nodes = nodes.selectExpr("node", "n - 1 + coalesce(links, 0) AS n_links", "coalesce(component, id) AS component_id")
    out = skew_join(marked.select("vec_id", "node"), nodes, ["node"], "left")
    out = out.selectExpr("vec_id", "coalesce(n_links, 0L) AS n_links", "coalesce(component_id, vec_id) AS component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
