"""From raw documents to packed sequences: quality classifier, line dedup, MinHash near-dedup, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import best_fit, bpe, line_dedup, minhash, quality
from tallyspark.llm.common import fresh, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of shared passages are cut out; a document of which nothing is left goes."""
    (gone,) = fresh(docs, "lines_dropped_")
    out = line_dedup.dedup_lines(docs, dropped=gone)
    left = out.where((F.col(gone) == 0) | F.col("text").isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each near-duplicate group."""
    return minhash.one_of_each(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return best_fit.pack_documents(docs, bpe.default_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Learned scores, alignments and packings have no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs, f"stage-{name}")
    return docs
