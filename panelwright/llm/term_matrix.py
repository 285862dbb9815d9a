"""Audit of how filters interact, over a sparse document-term matrix.

Words are encoded by a global dictionary and documents become rows of a sparse matrix, kept in shards of compressed rows.
Row sums (words) and numbers of nonzero entries (distinct words) decide two of the filters; the others' flags are attached,
and all orders of all filters are worked out from counts per combination of flags.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.shared import skew_join, written

FILTERS = "ABCDE"
#: Bytes of text in a shard, and the most that is split into words at once. A longer text is a shard of its own.
_SHARD, _PIECE = 8 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at white space."""
    start = 0
    while len(text) - start > _PIECE:
        end = _SPACE.search(text, start + _PIECE)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.end()
    yield text[start:] if start else text


class _Shard:
    """Rows of the matrix in the making: columns are numbered as their words appear."""

    def __init__(self) -> None:
        self.columns: defaultdict[bytes, int] = defaultdict()
        self.columns.default_factory = self.columns.__len__
        self.indptr, self.indices, self.data = [0], array("i"), array("i")
        self.bytes = 0

    def add(self, text: str | None) -> None:
        raw = (text or "").encode()
        counts: Counter[bytes] = Counter()
        for piece in _pieces(raw):
            counts.update(piece.split())  # bytes split at 09-0D and 20 and nowhere else
        self.indices.extend(map(self.columns.__getitem__, counts))
        self.data.extend(counts.values())
        self.indptr.append(len(self.indices))
        self.bytes += len(raw) + 64

    def batch(self, documents: list[pa.Array]) -> pa.RecordBatch:
        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        words = pa.array(list(self.columns), pa.binary()).cast(pa.string())
        parts = [pa.concat_arrays(documents), pa.array(self.indptr, pa.int64()), pa.array(np.array(self.indices, np.int32)), pa.array(np.array(self.data, np.int32)), words]
        return pa.RecordBatch.from_arrays([one(p) for p in parts], ["documents", "indptr", "indices", "data", "words"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, documents = _Shard(), []
    for batch in batches:
        column, start = batch.column("document"), 0
        for k, text in enumerate(batch.column("text")):
            shard.add(text.as_py())
            if shard.bytes >= _SHARD:
                yield shard.batch([*documents, column.slice(start, k + 1 - start)])
                shard, documents, start = _Shard(), [], k + 1
        if start < len(column):
            documents.append(column.slice(start))
    if documents:
        yield shard.batch(documents)


def document_term_shards(docs: DataFrame, document: Column) -> DataFrame:
    """The matrix of ``docs`` (text), written: one row per shard, about 8 MB of text each.

    documents (the struct ``document`` of each row of the matrix), indptr, indices, data (compressed rows: counts of the
    shard's columns) and columns (each column's global code), with words beside them. A null text is a row without
    entries. Codes are equal exactly for equal words, over all shards: a word's code is an even hash, and words that share a
    hash, expected from some 10^9 different words on, have odd codes, their ranks in the dictionary. So the dictionary
    never moves to the shards, and checking it shuffles two hashes per word and task.
    """
    rows = docs.select(document.alias("document"), "text")
    schema = T.StructType(
        [
            T.StructField("documents", T.ArrayType(rows.schema["document"].dataType)),
            T.StructField("indptr", T.ArrayType(T.LongType())),
            T.StructField("indices", T.ArrayType(T.IntegerType())),
            T.StructField("data", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
    columns = F.transform("words", lambda w: F.shiftleft(F.xxhash64(w), 1))
    shards = written(rows.mapInArrow(_build, schema).withColumn("columns", columns), "term-shards")
    pairs = shards.select(F.explode("words").alias("word")).select(F.shiftleft(F.xxhash64("word"), 1).alias("code"), F.xxhash64("word", F.lit(1)).alias("other"))
    shared = pairs.groupBy("code").agg(F.min("other").alias("first"), F.max("other").alias("last")).where("first != last").select("code")
    shared = written(shared, "shared-codes")
    return shards if shared.isEmpty() else _recoded(shards, shared)


def _recoded(shards: DataFrame, shared: DataFrame) -> DataFrame:
    """Shards in which words that share a hash have codes of their own."""
    shards = shards.withColumn("_shard", F.monotonically_increasing_id())
    shards = written(shards, "numbered-shards")
    terms = shards.select("_shard", F.posexplode(F.arrays_zip("words", "columns")).alias("place", "term"))
    terms = terms.select("_shard", "place", F.col("term.words").alias("word"), F.col("term.columns").alias("code")).join(shared, "code", "left_semi")
    own = terms.select("word").distinct().withColumn("own", F.row_number().over(Window.orderBy("word")).cast("long") * 2 + 1)
    patches = terms.join(own, "word").groupBy("_shard").agg(F.map_from_entries(F.collect_list(F.struct("place", "own"))).alias("_own"))
    patched = F.expr("IF(_own IS NULL, columns, transform(columns, (c, i) -> coalesce(try_element_at(_own, i), c)))")
    return shards.join(patches, "_shard", "left").withColumn("columns", patched).drop("_shard", "_own")


def dictionary(shards: DataFrame) -> DataFrame:
    """(word, code) of all words of the matrix."""
    terms = shards.select(F.explode(F.arrays_zip("words", "columns")).alias("term"))
    return terms.select(F.col("term.words").alias("word"), F.col("term.columns").alias("code")).distinct()


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            documents, indptr, data = (batch.column(name)[k].values for name in ("documents", "indptr", "data"))
            ends = np.asarray(indptr)
            total = np.concatenate(([0], np.cumsum(np.asarray(data), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([documents, pa.array(total[ends[1:]] - total[ends[:-1]]), pa.array(np.diff(ends))], ["document", "row_sum", "nonzero"])


def row_counts(shards: DataFrame) -> DataFrame:
    """(document, row_sum, nonzero) per row of the matrix: its words and distinct words."""
    kind = shards.schema["documents"].dataType.elementType
    schema = T.StructType([T.StructField("document", kind), T.StructField("row_sum", T.LongType()), T.StructField("nonzero", T.LongType())])
    return shards.select("documents", "indptr", "data").mapInArrow(_row_counts, schema)


def failing_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) per row of ``docs`` (doc_id, source, text); bit k of mask: it fails filter k of ABCDE.

    A: fewer than 50 words. B: distinct words below 65 % of words. C: capitals above 5 % of code points. D: holds
    one of #$%&*|. E: equal to the text of a smaller doc_id in the whole table. Null texts count as empty and so as equal to
    empty ones; rows without doc_id never fail E, and rows of one doc_id do not fail it by each other. good and toxic say
    that some row of ``labels`` (doc_id, quality, toxic) has quality 1, toxic 1. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    flags = F.when(capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    document = F.struct("doc_id", F.coalesce("source", F.lit("")).alias("part"), flags.alias("flags"), F.unhex(F.sha2(text, 256)).alias("digest"))
    counted = row_counts(document_term_shards(docs.select("doc_id", "source", "text"), document))
    short = F.when(F.col("row_sum") < 50, 1).otherwise(0) + F.when(100 * F.col("nonzero") < 65 * F.col("row_sum"), 2).otherwise(0)
    rows = written(counted.select("document.doc_id", "document.part", "document.digest", (F.col("document.flags") + short).alias("mask")), "filter-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = skew_join(rows, first, ["digest"]).withColumn("mask", F.expr("mask + IF(coalesce(doc_id > first, false), 16, 0)")).drop("digest", "first")
    marks = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    marked = skew_join(rows, marks, ["doc_id"], "left")
    return marked.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there.

    Columns: part (source; null: empty), filter_order, step, and counts of the part's documents: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (removed by the step's filter, summed over all orders). No documents: no
    rows. Documents are counted per part and combination of failed filters, at most 32 rows a part; orders are worked out
    from those.
    """
    masks = range(1 << len(FILTERS))
    counts = failing_filters(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    held = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in ("n", "good", "toxic") for m in masks]
    size = len(masks)
    cells = [F.array(*held[k * size : (k + 1) * size]).alias(c) for k, c in enumerate(("n", "good", "toxic"))]
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = counts.groupBy("part").agg(*cells).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = f"CAST(pow(2, instr('{FILTERS}', substr(filter_order, step, 1)) - 1) AS int)"
    earlier = " + ".join(f"IF(instr(filter_order, '{f}') < step, {1 << k}, 0)" for k, f in enumerate(FILTERS))
    steps = steps.withColumn("own", F.expr(own)).withColumn("earlier", F.expr(earlier))

    def total(cell: str, condition: str, worth: str = "x") -> Column:
        return F.expr(f"aggregate(transform({cell}, (x, m) -> IF({condition}, {worth}, 0L)), 0L, (a, b) -> a + b)")

    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "m & (earlier | own) = 0").alias("kept"),
        total("n", "m & earlier = 0 AND m & own != 0").alias("removed"),
        total("n", "m & earlier != 0 AND m & own != 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", "m & earlier = 0 AND m & own != 0").alias("good_lost"),
        total("toxic", "m & earlier = 0 AND m & own != 0").alias("toxic_lost"),
        # The filter comes first among the failed ones in an equal share of the orders.
        total("n", "m & own != 0", "x * (120 div bit_count(m))").alias("shapley"),
    )
