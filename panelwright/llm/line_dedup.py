"""Line de-duplication with a log-template tree.

A line falls to a leaf by its token count and leading tokens (fixed depth); tokens with digits are variable fields.
Within a leaf, lines that agree in most places share a template, and the places where they differ become variable too.
A template found in many documents is recurring: the first of them keeps its lines, all others lose them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import byte_steps, return_memory, skew_join, written

FIELD = "<*>"
_DIGIT = re.compile(r"\d")
_BITS = 1 << 24


def line_tokens(line: str, fields: bool = True) -> list[str]:
    tokens = line.split()
    if fields and _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[str], depth: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:depth])}") - (1 << 63)


class Templates:
    """Templates of one leaf, met by lines in a fixed order. Looked up by (place, token), not one by one.

    A line that matches a template differs from it in fewer than ``free`` places, so of the first ``free`` places after the
    leading ones at least one agrees or is a field already.
    """

    def __init__(self, tokens: int, depth: int, similarity: float) -> None:
        self.need = max(1, int(np.ceil(similarity * tokens - 1e-9)))
        self.probes = range(min(depth, tokens), min(tokens, depth + tokens - self.need + 1))
        self.all: list[list[str]] = []
        self.at: dict[tuple[int, str], set[int]] = {}

    def match(self, tokens: list[str]) -> int:
        if len(self.probes):
            near: set[int] = set()
            for p in self.probes:
                near |= self.at.get((p, tokens[p]), set())
                near |= self.at.get((p, FIELD), set())
        else:
            near = set(range(len(self.all)))
        for k in sorted(near):
            known = self.all[k]
            if sum(a == b for a, b in zip(known, tokens)) >= self.need:
                for p, (a, b) in enumerate(zip(known, tokens)):
                    if a != b:
                        known[p] = FIELD
                        if p in self.probes:
                            self.at.setdefault((p, FIELD), set()).add(k)
                return k
        self.all.append(list(tokens))
        for p in self.probes:
            self.at.setdefault((p, tokens[p]), set()).add(len(self.all) - 1)
        return len(self.all) - 1


def _lines(docs: DataFrame, depth: int, min_tokens: int, hot: object | None) -> DataFrame:
    """(doc_id, body, place, leaf, line): lines with their variable fields masked; with ``hot``, of its leaves only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if hot is None else np.frombuffer(hot.value, np.uint8)
        for batch in batches:
            for start, size in byte_steps(batch.column("text")):
                part = batch.slice(start, size)
                rows: list[tuple] = []
                for doc, body, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "text"))):
                    fields = _DIGIT.search(text) is not None
                    for place, line in enumerate(text.split("\n")):
                        tokens = line_tokens(line, fields)
                        if len(tokens) >= min_tokens:
                            leaf = leaf_of(tokens, depth)
                            b = leaf % _BITS
                            if bits is None:
                                rows.append((doc, body, place, leaf, None))
                            elif bits[b >> 3] >> (b & 7) & 1:
                                rows.append((doc, body, place, leaf, " ".join(tokens)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["doc_id", "body", "place", "leaf", "line"]
                )
        return_memory()

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return docs.mapInArrow(run, "doc_id long, body long, place int, leaf long, line string")


def _hot_leaves(lines: DataFrame, min_docs: int) -> bytes:
    """Bit map over leaf hashes, of a fixed 2 MB: leaves met by at least ``min_docs`` documents, and a few others."""
    met = lines.select("doc_id", "body", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    at = met.select(F.pmod("leaf", F.lit(_BITS)).alias("b"))
    blocks = at.groupBy((F.col("b") / 32768).cast("int").alias("block")).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits"))
    out = bytearray(_BITS // 8)
    for r in blocks.collect():
        out[r["block"] * 4096 : r["block"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def _grown(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Templates grown from the distinct lines of each (leaf, salt), streamed in order.

    (leaf, salt, line, number, form): a row with the template number per line, then one with the form per template (line
    null), which is known at the end of its leaf only. A task holds the templates of one leaf at a time, never its lines.
    """
    ordered = lines.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "line").select("leaf", "salt", "line")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
        return pa.RecordBatch.from_arrays(columns, ["leaf", "salt", "line", "number", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, templates = None, None

        def forms() -> list[tuple]:
            return [(*current, None, k, " ".join(t)) for k, t in enumerate(templates.all)] if templates else []

        for batch in batches:
            rows: list[tuple] = []
            for leaf, salt, line in zip(*(batch.column(c).to_pylist() for c in ("leaf", "salt", "line"))):
                tokens = line.split(" ")
                if (leaf, salt) != current:
                    rows += forms()
                    current, templates = (leaf, salt), Templates(len(tokens), depth, similarity)
                rows.append((leaf, salt, line, templates.match(tokens), None))
            yield batch_of(rows)
        yield batch_of(forms())

    return ordered.mapInArrow(run, "leaf long, salt long, line string, number long, form string")


def recurring_lines(
    docs: DataFrame,
    min_docs: int = 3,
    depth: int = 3,
    similarity: float = 0.8,
    min_tokens: int = 3,
    salts: int = 16,
) -> DataFrame:
    """(doc_id, body, places): the lines that documents lose. ``docs`` has doc_id, text and body (hash of the text).

    Documents are counted per template over all documents. Lines are first counted by leaf hash alone; only lines of
    leaves met by ``min_docs`` documents move. Equal lines are one row from then on; a leaf's distinct lines are dealt over
    ``salts`` tasks, whose templates then meet as lines.
    """
    leaves = _lines(docs, depth, min_tokens, None)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_leaves(leaves, min_docs))
    lines = written(_lines(docs, depth, min_tokens, hot), "recurring-lines")
    distinct = lines.select("leaf", "line").distinct().withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(salts)))
    first = written(_grown(distinct, depth, similarity), "leaf-templates")
    parts = first.where("form IS NOT NULL").select("leaf", "salt", "number", "form")
    again = _grown(parts.selectExpr("leaf", "0L AS salt", "form AS line").distinct(), depth, similarity)
    wholes = written(again, "whole-templates").where("line IS NOT NULL").selectExpr("leaf", "line AS form", "number AS whole")
    parts = parts.join(wholes, ["leaf", "form"]).select("leaf", "salt", "number", "whole")
    forms = first.where("line IS NOT NULL").select("leaf", "salt", "number", "line").join(parts, ["leaf", "salt", "number"])
    forms = forms.selectExpr("line", "leaf", "xxhash64(leaf, whole) AS template")
    placed = written(skew_join(lines, forms, ["leaf", "line"]).select("doc_id", "body", "place", "template"), "placed-lines")
    per_doc = placed.select("template", "doc_id", "body").distinct()
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "body")).alias("first"))
    recurring = recurring.where(F.col("n") >= min_docs).select("template", "first")
    lost = skew_join(placed, recurring, ["template"]).where("struct(doc_id, body) != first")
    return lost.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("place")).alias("places"))


def drop_recurring(docs: DataFrame, text: str = "text", **options: float) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus n_lines and n_dropped (existing ones are replaced).

    A template is recurring if at least ``min_docs`` documents have it; the document with the smallest doc_id keeps it.
    Lines of fewer than ``min_tokens`` tokens never count. Null texts have no lines (n_lines 0) and stay null; so do texts of
    rows without doc_id, which take no part. Rows repeated with equal doc_id and text are one document and end alike. A
    document that loses every line keeps an empty text.
    """
    base = docs.drop("n_lines", "n_dropped")
    keyed = base.withColumn("_body", F.xxhash64(text))
    known = keyed.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    lost = recurring_lines(known.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.col("_body").alias("body")), **options)
    lost = lost.selectExpr("doc_id AS _doc", "body AS _same", "places AS _places")
    joined = keyed.join(lost, (keyed["doc_id"] == lost["_doc"]) & (keyed["_body"] == lost["_same"]), "left")
    split = F.split(F.col(text), "\n")
    left = F.filter(split, lambda line, k: ~F.array_contains("_places", k))
    return joined.select(
        *[F.when(F.col("_places").isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in base.columns],
        F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).alias("n_dropped"),
    )
