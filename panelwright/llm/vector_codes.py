"""Vector codes: each part of a vector becomes the nearest entry of a small codebook, found by Orchard's search.

Every entry has a list of all entries by their distance from it. A search starts at some entry, walks that entry's list, and
jumps to the list of whatever improves on it; marked entries are not computed again. It stops where the list goes
beyond twice the distance reached, since no farther entry can be nearer. Searches of a batch walk side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import skew_join, written

#: Vectors whose searches walk side by side, and the largest component for which distances fit in 64 bits.
_STEP, _SMALL = 8192, 1 << 24
_MOST = (1 << 63) - 1


class Orchard:
    """A codebook (entries x components, whole numbers) with the neighbour list of every entry."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = entries[:, None, :] - entries[None, :, :]
        between = (apart * apart).sum(axis=2)
        self.order = np.array([sorted(range(len(entries)), key=lambda e, row=row: (row[e], e)) for row in between])
        self.between = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, vectors: np.ndarray, computed: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per vector, the nearest entry (the smaller of equally near ones) and its squared distance.

        Distances are compared by their squares: a list ends where an entry's is above four times the one reached. An
        equally near entry is within that, so ties are seen. ``computed`` receives the number of distances worked out.
        """
        n, size = len(vectors), len(self.entries)
        best = np.zeros(n, np.int64)
        gap = vectors - self.entries[0]
        reached = (gap * gap).sum(axis=1)
        marked = np.zeros((n, size), bool)
        marked[:, 0] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n)
        while len(going):
            at = best[going], place[going]
            going = going[self.between[at] <= 4 * reached[going]]
            entry = self.order[best[going], place[going]]
            place[going] += 1
            fresh = ~marked[going, entry]
            who, entry = going[fresh], entry[fresh]
            marked[who, entry] = True
            gap = vectors[who] - self.entries[entry]
            far = (gap * gap).sum(axis=1)
            better = (far < reached[who]) | ((far == reached[who]) & (entry < best[who]))
            who = who[better]
            best[who], reached[who], place[who] = entry[better], far[better], 0
            going = going[place[going] < size]
        if computed is not None:
            computed.append(int(marked.sum()))
        return best, reached


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) in steps; whole numbers of 64 bits where distances fit, of any size where not."""
    column = batch.column("vector")
    for low in range(0, len(column), _STEP):
        part = column.slice(low, _STEP)
        values = part.flatten().to_numpy(zero_copy_only=False)
        floors = np.floor(values)
        if len(floors) and np.abs(floors).max() > _SMALL:
            floors = np.array([int(x) for x in floors], object)
        else:
            floors = floors.astype(np.int64)
        yield low, floors.reshape(len(part), -1)


def _assigned(vectors: np.ndarray, searches: list[Orchard]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position: the parts, their entries and squared distances."""
    width = searches[0].entries.shape[1]
    for k, search in enumerate(searches):
        part = vectors[:, k * width : (k + 1) * width]
        if part.dtype != search.entries.dtype:
            part, search = part.astype(object), Orchard(search.entries.astype(object))
        yield part, *search.nearest(part)


def _sums(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for _, vectors in _blocks(batch):
                for k, (part, entry, _) in enumerate(_assigned(vectors, searches)):
                    counts[k] += np.bincount(entry, minlength=len(books[k]))
                    for e in np.unique(entry):
                        totals[k][e] += part[entry == e].sum(axis=0)
        rows = [(k, e, int(counts[k][e]), [Decimal(int(x)) for x in totals[k][e]]) for k in range(len(books)) for e in range(len(books[k])) if counts[k][e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], [], []), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))))],
            ["position", "entry", "n", "total"],
        )

    return run


def _codes(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        for batch in batches:
            for low, vectors in _blocks(batch):
                found = list(_assigned(vectors, searches))
                code = np.stack([entry for _, entry, _ in found], axis=1).astype(np.int32)
                error = np.minimum(sum(far.astype(object) for _, _, far in found), _MOST).astype(np.int64)
                kept = [batch.column(c).slice(low, len(code)) for c in ("vec_id", "label")]
                lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, len(books), dtype=np.int32), code.ravel())
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector): scale * component as double, exact for powers of two; rows that take no part are gone."""
    whole = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where((F.size("embedding") > 0) & sound).select("vec_id", "label", whole.alias("vector"))


def train(whole: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks by part position. They are all that the driver ever holds: parts x entries rows."""
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = np.array([[int(np.floor(x)) for x in r["vector"]] for r in first], object)
    width = start.shape[1] // parts
    books = [_narrowed(start[:, k * width : (k + 1) * width]) for k in range(parts)]
    for _ in range(rounds):
        sums = whole.select("vector").mapInArrow(_sums(books), "position int, entry int, n long, total array<decimal(38,0)>")
        total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)])
        for r in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
            book = books[r["position"]].astype(object)
            book[r["entry"]] = [int(x) // r["n"] for x in r["total"]]
            books[r["position"]] = book
        books = [_narrowed(b) for b in books]
    return books


def _narrowed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if max(abs(int(x)) for x in book.ravel()) <= _SMALL else book.astype(object)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, empty or holds null or non-finite components are dropped; so are rows whose vector has another
    length than that of the smallest vec_id kept, which no codebook fits. Codebooks start from the ``entries`` smallest
    vec_ids (null last, equal ones by vector; fewer rows: fewer entries). code is the entry of each part, error the sum of
    squared distances, label_error that sum over rows of the label (nulls are one label). Equal rows are equal rows
    of the result; no rows kept: no rows. Sums are exact below 10^38; errors beyond 64 bits are given as the
    largest 64-bit number. Raises if the vector cannot be cut into ``parts`` equal parts. Other columns are not read.
    """
    key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {key_type}, label {label_type}, code array<int>, error long"
    whole = written(whole_vectors(vectors, scale), "whole-vectors")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    if first["n"] % parts:
        raise ValueError(f"vectors of {first['n']} components have no {parts} equal parts")
    whole = whole.where(F.size("vector") == first["n"])
    books = train(whole, parts, entries, rounds)
    coded = written(whole.mapInArrow(_codes(books), schema), "vector-codes")
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    by_label = coded.groupBy(*key).agg(F.sum("error").alias("label_error"))
    return skew_join(coded.select("*", *key), by_label, ["_none", "_label"]).drop("_none", "_label").withColumn("codebooks_sha256", F.lit(digest(books)))
