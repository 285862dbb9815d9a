"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard.

Weights are tf * idf. idf falls with the share s of documents that have the shingle, as 1 + ln(1/s), and is level for
shares below ``idf_share``: a rare shingle's weight must not hang on how rare it is, or one edited word would outweigh ten
shared ones. Shares come from a table of fixed size that counts documents by shingle hash; each entry is too large by
the share of documents that meet it by chance, which depends on the length of documents and not on their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import byte_steps, components, return_memory, skew_join, written

_TABLE = 1 << 20  # entries of the document-frequency table
_BLOCK = 1 << 12
_SLICE = 1 << 12  # entries of each table of random draws
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
#: Shingles per step of the sampler, so that a step stays in the processor's cache.
_STEP = 1024


class ShingleReader:
    """Shingles of whole texts, hashed over the bytes of all texts at once; words lie between ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.code = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.code[self.space] = 0
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _word_hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if len(self.power) < len(data):
            n = len(data) * 2
            self.power = np.cumprod(np.full(n, _PRIME))
            self.inverse = np.cumprod(np.full(n, np.uint64(pow(int(_PRIME), -1, 1 << 64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.code[data] * self.power[: len(data)])))
        inside = np.concatenate(([False], ~self.space[data]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        h = (total[ends] - total[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        return h, np.searchsorted(np.cumsum(lengths), starts, side="right")

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(40-bit hash, count, index of the text), by text; a text of fewer words than a shingle is one shingle."""
        h, owner = self._word_hashes(texts)
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(h) - self.words + 1
        full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            full = np.zeros(n, np.uint64)
            for j in range(self.words):
                full = full * _PRIME + h[j : j + n]
            whole = owner[:n] == owner[self.words - 1 :]
            full, of = full[whole], owner[:n][whole]
        count = np.bincount(owner, minlength=len(texts))
        for k in np.flatnonzero((count > 0) & (count < self.words)):
            own, value = np.searchsorted(owner, k), np.uint64(0)
            for j in range(count[k]):
                value = value * _PRIME + h[own + j : own + j + 1]
            full, of = np.append(full, value), np.append(of, k)
        full ^= full >> np.uint64(31)
        full *= np.uint64(0x7FB5D329728EA185)
        full ^= full >> np.uint64(29)
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (full & _LOW))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[first] & _LOW, np.diff(np.append(first, len(key))), (key[first] >> np.uint64(40)).astype(np.int64)


def _idf(df: np.ndarray, documents: int, idf_share: float) -> np.ndarray:
    """Weight by entry of the table, 1 for shares below ``idf_share``."""
    share = np.minimum(1.0, np.maximum(df, 1) / max(documents, 1))
    return (np.minimum(1, (1 - np.log(share)) / (1 - np.log(idf_share)))).astype(np.float32)


def document_frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """Documents per entry of the table, over all rows of ``docs`` (text). 4 MB a task are combined by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reader = np.zeros(_TABLE, np.int64), ShingleReader(words)
        for batch in batches:
            for start, size in byte_steps(batch.column("text")):
                h, _, _ = reader.read(batch.column("text").slice(start, size).to_pylist())
                total += np.bincount((h % np.uint64(_TABLE)).astype(np.int64), minlength=_TABLE)
        blocks = [k for k in range(_TABLE // _BLOCK) if total[k * _BLOCK : (k + 1) * _BLOCK].any()]
        counts = [total[k * _BLOCK : (k + 1) * _BLOCK].astype("<i8").tobytes() for k in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())], ["block", "counts"])
        del total, reader, counts
        return_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"]
        )

    schema = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(_TABLE, np.int64)
    for r in summed.collect():  # one row a block: the table's fixed 8 MB
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<i8")
    return out


class Sampler:
    """Improved consistent weighted sampling: ``size`` samples per weighted set.

    For sample k and element x with weight w: t = floor(ln w / r + b), ln y = r (t - b), value = ln c - ln y - r with r, c from
    Gamma(2, 1) and b uniform, all fixed by (k, x); the element of least value is the sample. The draws come from tables
    that are met by different bits of the element's hash. As a value is fixed by (k, x, t), it stands for the sample.
    """

    def __init__(self, size: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, (_SLICE, size)).astype(np.float32)
        self.b = rng.random((_SLICE, size), np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (_SLICE, size))).astype(np.float32)
        self.plain = self.r * (np.float32(1) - self.b)  # r - r b: what t = 0 takes off

    def sample(self, h: np.ndarray, w: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
        out = np.full((sets, self.r.shape[1]), np.inf, np.float32)
        for start in range(0, len(h), _STEP):
            x, weight, own = h[start : start + _STEP], w[start : start + _STEP], owner[start : start + _STEP]
            i, j = (x & np.uint64(_SLICE - 1)).astype(np.int64), (x >> np.uint64(20) & np.uint64(_SLICE - 1)).astype(np.int64)
            value = self.log_c[i] - self.plain[j]
            other = np.flatnonzero(weight != 1)
            if len(other):
                r, b = self.r[j[other]], self.b[j[other]]
                t = np.floor(np.log(weight[other])[:, None] / r + b)
                value[other] = self.log_c[i[other]] - r * (t - b) - r
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sets_here = own[edges]
            out[sets_here] = np.minimum(out[sets_here], np.minimum.reduceat(value, edges, axis=0))
        return out


def _signatures(docs: DataFrame, words: int, bands: int, rows: int, table: Broadcast) -> DataFrame:
    """(doc_id, digest, buckets) of ``docs`` (doc_id, digest, text): one bucket hash per band; texts without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sampler = ShingleReader(words), Sampler(bands * rows)
        mix = np.random.default_rng(11).integers(1, 1 << 62, (bands, rows)).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            for start, size in byte_steps(batch.column("text")):
                part = batch.slice(start, size)
                h, n, owner = reader.read(part.column("text").to_pylist())
                w = n * table.value[(h % np.uint64(_TABLE)).astype(np.int64)]
                got = np.unique(owner)
                # Adding zero makes -0 and 0 one value.
                bits = (sampler.sample(h, w, owner, size)[got] + np.float32(0)).view(np.uint32).astype(np.uint64)
                keys = (bits.reshape(len(got), bands, rows) * mix).sum(2)
                keys ^= keys >> np.uint64(31)
                keys = keys * _PRIME + np.arange(bands, dtype=np.uint64)
                columns = [
                    *(part.column(c).take(pa.array(got)) for c in ("doc_id", "digest")),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "buckets"])
        del reader, sampler
        return_memory()

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, buckets array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, table: Broadcast, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs with weighted Jaccard similarity of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShingleReader(words)
        for batch in batches:
            similar = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                h, n, owner = reader.read([left.as_py(), right.as_py()])
                w = n * table.value[(h % np.uint64(_TABLE)).astype(np.int64)]
                cut = np.searchsorted(owner, 1)
                _, i, j = np.intersect1d(h[:cut], h[cut:], assume_unique=True, return_indices=True)
                shared = np.minimum(w[:cut][i], w[cut:][j]).sum()
                similar.append(float(shared / (w.sum() - shared)))
            found = [*(batch.column(c) for c in ("a", "b")), pa.array(similar, pa.float64())]
            yield pa.RecordBatch.from_arrays(found, ["a", "b", "similarity"])
        return_memory()

    right = texts.selectExpr("node AS b", "text AS right")
    left = texts.selectExpr("node AS a", "text AS left")
    # The hubs (b) first: their text then travels with small rows, and the second join deals by the other end.
    both = skew_join(skew_join(pairs, right, ["b"]), left, ["a"])
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def document_classes(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 20, rows: int = 4, idf_share: float = 0.1, block: int = 256
) -> DataFrame:
    """(digest, class_id, class_digest) per distinct text of ``docs`` (doc_id, text) that has a word.

    digest is the text's MD5; class_id and class_digest are the smallest (doc_id, digest) that the text is linked to by any
    path. Rows without doc_id take no part.

    Equal texts become one node. Every node is compared with the most central member that it shares a bucket with, then,
    wherever it is still in another component, with the most central member of each of its buckets: a pair per member at
    most. Buckets that hold several components after that are compared in full, in blocks of about ``block`` texts, inside
    tasks, and give back only links that join components. So no bucket is gathered, no pair is a row of a join, and no
    link between members of a bucket is lost but those within a component.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), "text")
    spark = docs.sparkSession
    weights = _idf(document_frequencies(known, words), known.count(), idf_share)
    table = spark.sparkContext.broadcast(weights)
    signed = written(_signatures(known, words, bands, rows, table), "signatures")
    groups = signed.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("buckets").alias("buckets"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "texts")
    placed = groups.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(skew_join(placed, shared, ["bucket"]), "bucket-members")
    # Central texts share buckets with many others: the original of edited copies more than any copy.
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = written(skew_join(members, central, ["node"]), "weighed-members")
    texts = known.join(members.select("node").distinct().join(groups, "node").select("node", "digest", F.col("doc").alias("doc_id"), "buckets"), ["digest", "doc_id"])
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text"), F.first("buckets").alias("buckets")), "bucket-texts")

    top = F.max_by(F.col("node"), F.struct(F.col("weight"), -F.col("node"))).alias("hub")
    hubs = written(members.groupBy("bucket").agg(top, F.max("weight").alias("hub_weight")), "bucket-hubs")
    held = written(skew_join(members.select("bucket", "node", "n"), hubs, ["bucket"]), "hub-members")
    best = F.max_by("hub", F.struct(F.col("hub_weight"), -F.col("hub"))).alias("hub")
    tries = held.where("node != hub").groupBy("node").agg(best)
    links = written(_verified(tries.selectExpr("node AS a", "hub AS b"), texts, words, table, threshold), "links")
    links, labelled = _with_hubs(links, held, texts, words, table, threshold)
    links, labelled = _in_blocks(links, labelled, held, texts, words, table, threshold, block)

    per_text = groups.select("node", "digest", "doc").join(labelled, "node", "left").select("digest", "doc", F.coalesce("component", "node").alias("component"))
    least = per_text.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("least"))
    return skew_join(per_text, least, ["component"]).select("digest", F.col("least.doc").alias("class_id"), F.col("least.digest").alias("class_digest"))


def near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, class_id, kept), a row per row of ``docs`` (doc_id, text): class_id is the smallest doc_id that a document
    is linked to by any path; kept marks the document of that id, or of several texts of that id the first by MD5.

    Documents link if their weighted Jaccard similarity over shingles of ``words`` words is at least ``threshold``, or if their
    texts are equal (options: see ``document_classes``). Null texts and texts without a word link with nothing and are
    kept. Rows without doc_id get null class_id and are kept. Repeated rows are each returned, in the same class; so are
    different texts of one doc_id, each in its own.
    """
    classes = written(document_classes(docs, **options), "text-classes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.unhex(F.md5("text"))).alias("digest"))
    out = skew_join(rows, classes, ["digest"], "left")
    kept = (F.col("class_id") == F.col("doc_id")) & (F.col("class_digest") == F.col("digest"))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near copies: one row of each class of ``document_classes``.

    It is a row of the smallest doc_id of the class; where rows repeat with equal doc_id and text, the first by a hash of
    all columns. Rows without doc_id, with null text or without a word are nobody's copy and stay. No column is added or
    lost, whatever its name.
    """
    classes = document_classes(docs, **options)
    first = classes.where("digest = class_digest").select(F.col("class_id").alias("_doc"), F.col("digest").alias("_digest"))
    first = written(first, "class-texts")
    classed = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    alone = docs.where(~classed)
    keyed = docs.where(classed).select(
        F.col("doc_id").cast("long").alias("_doc"), F.unhex(F.md5("text")).alias("_digest"), F.struct(*docs.columns).alias("_row")
    )
    # Rows of one doc_id and text become one within their tasks, before they move.
    one = keyed.groupBy("_doc", "_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.join(first, ["_doc", "_digest"], "left_semi").select("_row.*").unionByName(alone)


def _with_hubs(links: DataFrame, held: DataFrame, texts: DataFrame, words: int, table: Broadcast, threshold: float) -> tuple[DataFrame, DataFrame]:
    """More links, of members to their buckets' hubs in other components, and (node, component) with them."""
    labels = _labels(links)
    at = skew_join(held, labels, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    at = skew_join(at, labels.selectExpr("node AS hub", "component AS hub_component"), ["hub"], "left")
    pairs = at.where(F.col("component") != F.coalesce("hub_component", "hub")).selectExpr("node AS a", "hub AS b").distinct()
    links = written(links.union(_verified(pairs, texts, words, table, threshold)), "links")
    return links, _labels(links)


def _in_blocks(
    links: DataFrame, labels: DataFrame, held: DataFrame, texts: DataFrame, words: int, table: Broadcast, threshold: float, block: int
) -> tuple[DataFrame, DataFrame]:
    """More links, within buckets that still hold several components, and (node, component) with them.

    The members of a bucket are dealt over blocks, and every two blocks meet in one group: a member moves once per block of
    its bucket. A pair is worked on in the first of its buckets only.
    """
    at = written(skew_join(held, labels, ["node"], "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    mixed = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = skew_join(at, mixed, ["bucket"]).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "component", "own")
    full = skew_join(dealt, texts, ["node"])

    def run(group: pa.Table) -> pa.Table:
        pairs = _spanning_links(group.combine_chunks(), ShingleReader(words), table.value, threshold)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*pairs) if pairs else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    found = full.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long, similarity double")
    links = written(links.union(found), "links")
    return links, _labels(links)


def _spanning_links(group: pa.Table, reader: ShingleReader, weights: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (node, node, similarity) that join components of a group: two blocks of a bucket, or one with itself."""
    node, component, own = (group.column(c).to_numpy() for c in ("node", "component", "own"))
    bucket, lo, hi = (group.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
    bands = np.array(group.column("buckets").to_pylist(), np.int64)
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    open_pairs = component[left][:, None] != component[right][None, :]
    if lo == hi:
        open_pairs &= left[:, None] < right[None, :]
    for k in range(int(np.flatnonzero(bands[0] == bucket)[0])):  # pairs that met in an earlier band
        open_pairs &= bands[left, k][:, None] != bands[right, k][None, :]
    rows, columns = open_pairs.any(1), open_pairs.any(0)
    left, right, open_pairs = left[rows], right[columns], open_pairs[rows][:, columns]
    if not open_pairs.any():
        return []
    texts = group.column("text").combine_chunks()
    a, b = (_elements(texts.take(pa.array(side)), reader, weights) for side in (left, right))
    both = np.intersect1d(a[0], b[0])
    shared = np.zeros(open_pairs.shape)
    for start in range(0, len(both), 1 << 12):
        part = both[start : start + (1 << 12)]
        shared += _dense(a, part, len(left), True) @ _dense(b, part, len(right), False).T
    total = np.bincount(a[1], a[2], len(left))[:, None] + np.bincount(b[1], b[2], len(right))[None, :]
    similar = np.where(open_pairs, shared / (total - shared), 0.0)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    out = []
    hits = np.argwhere(similar >= threshold)
    for i, j in hits[np.argsort(-similar[tuple(hits.T)], kind="stable")].tolist():
        x, y = find(int(component[left[i]])), find(int(component[right[j]]))
        if x != y:
            root[x] = y
            out.append((int(node[left[i]]), int(node[right[j]]), float(similar[i, j])))
    return out


def _elements(texts: pa.Array, reader: ShingleReader, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, index of the text, weight): a shingle that a text has n times is n elements."""
    found = []
    for start, size in byte_steps(texts):
        h, n, owner = reader.read(texts.slice(start, size).to_pylist())
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append((np.repeat(h, n) | copy.astype(np.uint64) << np.uint64(40), np.repeat(owner, n) + start, np.repeat(weights[(h % np.uint64(_TABLE)).astype(np.int64)], n)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _dense(elements: tuple[np.ndarray, np.ndarray, np.ndarray], columns: np.ndarray, rows: int, weighted: bool) -> np.ndarray:
    at = np.minimum(np.searchsorted(columns, elements[0]), len(columns) - 1)
    met = columns[at] == elements[0]
    out = np.zeros((rows, len(columns)))
    out[elements[1][met], at[met]] = elements[2][met] if weighted else 1.0
    return out


def _labels(links: DataFrame) -> DataFrame:
    return written(components(links.select("a", "b")).withColumnRenamed("id", "node"), "components")
