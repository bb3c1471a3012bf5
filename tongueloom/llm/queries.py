"""The registered queries of this package: ``(spark, sf_dir)`` to a DataFrame.

Each reads its whole table through the operator and derives the columns of the result from the operator's output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tongueloom.llm import alignment, bitplanes, bytebpe, decontaminate, lattice, pieces, pseudonyms, toxicity, urlfilter
from tongueloom.llm.common import crc_bucket, read
from tongueloom.llm.gru import language_scores
from tongueloom.llm.lines import dedup_lines
from tongueloom.llm.minhash import near_duplicates
from tongueloom.llm.spelling import spelling_groups

TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")  # a folder that every worker has
END_ID = 2


def piece_codec(**more) -> pieces.PieceCodec:
    return pieces.PieceCodec(model=f"{TOKENIZERS}/piece_bpe_32k.model", **more)


def byte_codec(**more) -> bytebpe.ByteCodec:
    return bytebpe.ByteCodec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, **more)


def pairing(**more) -> alignment.Pairing:
    return alignment.Pairing(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), **more)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = piece_codec()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.round_trip(docs, codec)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("n_bytes"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_cut", "removed", "text")


def op4_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest")


def op6_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = bitplanes.token_folder(docs)
    shards = bitplanes.write_tokens(docs, folder, f"{TOKENIZERS}/word_bpe_49k.json", END_ID)
    return bitplanes.read_tokens(shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, os.environ.get("PSEUDONYM_KEY", "a key of the job"))
    kinds = [F.expr(f"cast(size(filter(found, v -> v.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pseudonyms.KINDS]
    return out.select("doc_id", *kinds, F.transform("found", lambda v: v["pseudonym"]).alias("pseudonyms"), "text")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    out = urlfilter.judge(urlfilter.captures_of(pages), urlfilter.log_of(pages))
    return out.select("page_id", F.col("day").cast("string").alias("day"), "n_active", F.concat_ws(",", "active").alias("active"), "blocked")


def op11_bytetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = byte_codec()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bytebpe.decode(bytebpe.encode(docs, codec, keep=["doc_id"]), codec)
    return both.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))


def op13_gallop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(read(spark, sf_dir, "documents"), pairing())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_minhash": op2_minhash,
    "op3_winnowing": op3_winnowing,
    "op4_gru": op4_gru,
    "op5_decontaminate": op5_decontaminate,
    "op6_bitplanes": op6_bitplanes,
    "op7_lattice": op7_lattice,
    "op8_toxicity": op8_toxicity,
    "op9_urls": op9_urls,
    "op10_feistel": op10_feistel,
    "op11_bytetree": op11_bytetree,
    "op12_spelling": op12_spelling,
    "op13_gallop": op13_gallop,
}
