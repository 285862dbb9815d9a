"""Cleaning a corpus: five stages from documents to tokens, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from panelwright.llm.queries import tokenizer_model
from panelwright.llm.shared import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labelled documents teach; null texts and texts without a letter go."""
    return language_id.reject_unknown(docs, language_id.learn(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across documents (n_chars follows); a document that loses all of them goes.

    Null texts have no lines and stay. Rows repeated with equal doc_id and text lose the same lines.
    """
    return from_packed(docs, line_dedup.drop_recurring(packed(docs, "doc_id", "text")).where((F.col("n_dropped") == 0) | (F.trim("text") != "")))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns, and all others out of reach in one, so that columns a stage adds cannot clash with them."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others).alias("_others")) if others else docs.select(*needed)


def from_packed(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a changed ``packed`` one; n_chars is counted again where lines were dropped."""
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("_others")[c] for c in docs.columns}
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, counted).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id.

    Different texts of one doc_id are different documents; repeated rows are one. Documents without doc_id, text or words are
    nobody's copy and stay.
    """
    return minhash_dedup.one_of_each(docs)


def interleave_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, written in the order of the mix."""
    mixed = mixing.mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("_packed")))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("_packed.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they decode to."""
    return sentencepiece_codec.round_trip(docs.select("doc_id", "text"), tokenizer_model(), cache_size=100_000).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_recurring_lines),
    ("minhash_dedup", keep_one_of_near_copies),
    ("mixing", interleave_sources),
    ("sentencepiece", tokenize),
]
#: Null: model fits, components and encodings have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
