"""Pipeline over ``documents``: toxicity, repeated lines, near-duplicates, benchmark passages, sub-word pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tongueloom.llm import decontaminate, pieces, toxicity
from tongueloom.llm.common import attach, read, unused
from tongueloom.llm.lines import dedup_lines
from tongueloom.llm.minhash import near_duplicates
from tongueloom.llm.queries import piece_codec
from tongueloom.session import fresh_path, stage


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with the number of characters of the text as it is now."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that occurred before; a document of which nothing is left goes."""
    out = dedup_lines(docs).where("size(removed) = 0 or trim(BOTH ' \t\n\r' FROM text) <> ''")
    return _recounted(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id."""
    text_hash = unused(docs, "text_hash")
    gone = near_duplicates(docs).where("not kept").select("doc_id", F.col("text_hash").alias(text_hash)).distinct()
    return attach(docs.withColumn(text_hash, F.xxhash64("text")), stage(gone, "near-copies"), ["doc_id", text_hash], "left_anti").drop(text_hash).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are little else go."""
    return _recounted(decontaminate.remove_hits(docs, read(spark, sf_dir, "benchmark")), docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text that they decode to."""
    codec = piece_codec()
    both = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), codec)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", remove_benchmark),
    ("sentencepiece", to_pieces),
]
ORACLE_SQL = None  # learned scores and an LSH search have no SQL form; the stages are tested one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read back for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
