"""What several operators need: lineage cuts in the shared folder, connected components, input clean-up."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, one of our own in a local session; on a
    cluster that is an error, as executors would write to their own disks."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of now, read back from the shared folder; a lost executor costs no recomputation beyond it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but as compressed columns: for tables with texts or vectors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which Spark can split a hot key's partition.

    It splits only exchanges made for the join itself. An aggregate by the same key below would lend its own, so the join
    takes a second key, a function of the first.
    """
    key = F.xxhash64(*on)
    return left.withColumn("_key_hash", key).join(right.withColumn("_key_hash", key), [*on, "_key_hash"], how).drop("_key_hash")


def return_memory() -> None:
    """Give what a task has freed back to the system: Python workers are kept for later tasks, with all they ever held."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def byte_steps(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(start, rows) of steps through a column of texts, of about ``size`` bytes or one text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > size:
            yield start, k - start
            start, held = k, 0
        held += n + 64
    if start < len(lengths):
        yield start, len(lengths) - start


def pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """Parts of a text of ``size`` characters or a little more, each ending behind white space; twice as many where there is none."""
    start = 0
    while len(text) - start > 2 * size:
        end = start + size
        while end < start + 2 * size and not text[end - 1].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b: long) is linked to, by any path.

    Large-star and small-star steps: every node hangs its larger neighbours, then its smaller ones, onto the smallest
    neighbour, until only stars remain. A hub's smallest neighbour is an aggregate that combines in the tasks; its
    edges meet that one row in a join that Spark may split. Self-links and repeated links are harmless; no links: no
    rows. Raises if ``max_rounds`` do not suffice (the number needed grows with the logarithm of the longest chain).
    """
    stars = cut(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct())
    before = _state(stars)
    for _ in range(max_rounds):
        both = stars.union(stars.selectExpr("v AS u", "u AS v"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(both, smallest, ["u"]).where("v > u AND v > m").selectExpr("v AS u", "m AS v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, smallest, ["u"]).selectExpr("explode(array(struct(v AS u, m AS v), struct(u AS u, m AS v))) AS e")
        stars = cut(small.select("e.*").where("u > v").distinct())
        now = _state(stars)
        if now == before:
            roots = stars.selectExpr("v AS id", "v AS component").distinct()
            return stars.selectExpr("u AS id", "v AS component").union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.selectExpr("count(*)", "bit_xor(xxhash64(u, v))", "bit_xor(xxhash64(v, u, 1))").first()
    return tuple(row)
