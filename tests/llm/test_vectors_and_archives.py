"""Vector operators, WARC and components: against brute force, and on null, empty, repeated and non-finite rows."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import exact_topk, hnsw_dedup, warc
from panelwright.llm.queries import QUERIES
from panelwright.llm.shared import components

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def tables(spark, tmp_path):
    def build(rows, name, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build


@pytest.fixture(scope="module")
def vectors():
    """Random directions, near copies of some, equal ones, and rows that take no part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[300:500] = x[:200] + rng.normal(scale=0.06, size=(200, 16)) * rng.integers(1, 5, (200, 1))
    x[500:560] = x[7]
    rows = [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(x)]
    return rows + [(700, None, 0), (750, [0.0] * 16, 1), (800, [float("nan")] + [1.0] * 15, 1), (850, [None] + [1.0] * 15, None), (900, [float("inf")] * 16, 2)]


def finite(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_top_k_equals_brute_force(spark, tables, vectors):
    got = QUERIES["op3_exact_topk"](spark, tables(vectors, "embeddings", VECTORS)).collect()
    whole = {k: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for k, v, _ in vectors if finite(v)}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:5]
            want |= {(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rng = np.random.default_rng(9)
    rows = [(k % 60, np.floor(rng.normal(size=6) * 8)) for k in range(150)]
    rows += [(50, rows[50][1]), (None, rows[0][1])]
    got = exact_topk.top_k(spark.createDataFrame([(k, v.tolist()) for k, v in rows if k is not None], "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0, cell_rows=16)
    want = []
    known = [(n, k, v) for n, (k, v) in enumerate(rows) if k is not None]
    for n, q, x in known:
        if q % 50 == 0:
            best = sorted((-int(x @ v), k) for m, k, v in known if m != n)[:5]
            want += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_k_over_many_cells_equals_brute_force(spark, vectors):
    """Small cells and many pivots, so that several annuli are visited."""
    whole = {k: np.floor(256 * np.array(v, np.float64)) for k, v, _ in vectors if finite(v)}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in whole.items()], "vec_id long, v array<double>")
    got = exact_topk.top_k(frame, F.col("vec_id") % 70 == 0, k=3, pivots=16, rings=16, cell_rows=8).collect()
    for q in {r["query_id"] for r in got}:
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:3]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best
    assert {r["query_id"] for r in got} == {k for k in whole if k % 70 == 0}


@pytest.mark.parametrize("rows, n", [([], 0), ([(0, [1.0])], 0), ([(0, [1.0]), (1, [2.0]), (2, [2.0])], 2)])
def test_top_k_with_fewer_than_k(spark, rows, n):
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    assert exact_topk.top_k(frame, F.col("vec_id") % 50 == 0).count() == n


def classes(rows, least):
    x = {k: np.array(v, np.float64) for k, v, _ in rows if finite(v) and np.any(v)}
    ids = np.array(list(x))
    unit = np.array([v / np.linalg.norm(v) for v in x.values()])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    links, root = dict(zip(ids, near.sum(1))), np.arange(len(ids))
    for _ in ids:
        root = np.array([min(root[k], *root[near[k]]) if near[k].any() else root[k] for k in range(len(ids))])
    return links, dict(zip(ids, ids[root]))


def test_near_vectors_equal_brute_force(spark, tables, vectors):
    links, root = classes(vectors, 0.95)
    got = QUERIES["op6_hnsw_dedup"](spark, tables(vectors, "embeddings", VECTORS)).collect()
    assert len(got) == len(vectors)
    assert {r["vec_id"]: r["component_id"] for r in got} == {k: root.get(k, k) for k, _, _ in vectors}
    assert {r["vec_id"]: r["n_links"] for r in got} == {k: links.get(k, 0) for k, _, _ in vectors}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_beam_search_equals_a_search_one_by_one():
    """Queries that end early and late, side by side, meet the same nodes as each alone; a beam of all nodes meets all that links reach."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = hnsw_dedup.build_graph(x, 6, 20)
    links[390:] = -1  # dead ends
    q = np.concatenate((x[:40] + rng.normal(scale=0.02, size=(40, 12)), rng.normal(size=(20, 12))))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    entry = np.concatenate((np.full((30, 1), 395), rng.integers(0, 390, (30, 1))))
    before = links.copy()
    ids, sims = hnsw_dedup.beam_search(q, x, links, entry, 10)
    assert (links == before).all()
    for k in range(len(q)):
        alone, own = hnsw_dedup.beam_search(q[k : k + 1], x, links, entry[k : k + 1], 10)
        assert set(alone[0]) == set(ids[k]) and np.allclose(np.sort(own[0]), np.sort(sims[k]))
    assert all(set(row) == {395, -1} for row in ids[:30])
    ids, sims = hnsw_dedup.beam_search(q[30:], x, links, entry[30:], 400)
    for row, start in zip(ids, entry[30:, 0]):
        reached, border = {start}, {start}
        while border:
            border = {int(v) for u in border for v in links[u] if v >= 0} - reached
            reached |= border
        assert set(row[row >= 0]) == reached
    assert np.allclose(np.where(ids >= 0, (q[30:] @ x.T)[np.arange(30)[:, None], ids], -2), sims)


def test_near_vectors_over_several_shards(spark, vectors):
    links, root = classes(vectors, 0.95)
    got = hnsw_dedup.near_duplicates(spark.createDataFrame(vectors, VECTORS), shard_rows=100).collect()
    found = sum(r["n_links"] for r in got)
    assert 0.98 * sum(links.values()) <= found <= sum(links.values())
    assert sum(r["component_id"] == root.get(r["vec_id"], r["vec_id"]) for r in got) >= 0.98 * len(got)


def test_no_vectors_and_no_pages(spark, tables):
    d = tables([], "embeddings", VECTORS)
    tables([], "pages", "page_id long, url string, html string")
    assert QUERIES["op3_exact_topk"](spark, d).collect() == []
    assert QUERIES["op6_hnsw_dedup"](spark, d).collect() == []
    assert QUERIES["op2_warc"](spark, d).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (2, 1)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in [100, *range(200, 250)]}


PAGES = [
    (1, "http://a", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://c\r\nX: y", None),
    (4, "http://d", ""),
    (5, "http://e", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (6, "http://f", "line\nWARC/1.1\nmore\r\n\r\nüñí" + "x" * 50_000),
    (7, "http://g", "<p>one</p>"),
]


def test_archives_come_back_whole(spark, tables):
    d = tables(PAGES, "pages", "page_id long, url string, html string")
    got = {r["page_id"]: r for r in QUERIES["op2_warc"](spark, d).collect()}
    assert set(got) == {p[0] for p in PAGES}
    first = {}
    for k, _, html in PAGES:
        body = (html or "").encode()
        owner = first.setdefault(body, k)
        assert got[k]["payload_bytes"] == len(body)
        assert got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got[k]["record_type"] == ("response" if owner == k else "revisit")
        assert got[k]["refers_to"] == (None if owner == k else owner)


def test_records_cut_by_splits_and_false_records_in_payloads(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"), min_bytes=1 << 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["record_id"], bytes(r["payload"]).decode()) for r in rows) == [(f"<urn:x-page:{k}>", html or "") for k, _, html in PAGES]
