"""Seeded shuffles, splits, language probabilities, shards, batch plans and bootstrap draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tongueloom.functions.hashing import SPAN, digest, hash32, hash60, hash_word, uniform
from tongueloom.operators.rank import cut_points, exact_rank, running_sum
from tongueloom.session import buckets, lookup_join, stage

MICRO = 1_000_000
TICKS_PER_BUCKET = 4096
DRAW_BLOCK = 100_000  # draws listed by one row


def shuffle(corpus: DataFrame, *seed) -> DataFrame:
    """Random order of the records of each language: ``pos`` from 1, ``total`` rows per language."""
    keyed = corpus.withColumn("digest", digest(*seed, F.col("row_id")))
    return exact_rank(keyed, ["lang"], "digest", ["row_id"], "pos", "total")


def stack_order(corpus: DataFrame, *seed) -> DataFrame:
    """One corpus of all languages: language by language, shuffled inside each (``pos`` is global)."""
    n = buckets(corpus.sparkSession)
    keyed = corpus.withColumn("digest", digest(*seed, F.col("row_id")))
    bucket = F.struct("lang", F.floor(hash_word(F.col("digest")) * F.lit(n) / F.lit(SPAN)).alias("part"))
    return running_sum(keyed, [], bucket, ["lang", "digest", "row_id"], "pos")


def split(corpus: DataFrame, holdout: float, *seed) -> DataFrame:
    """Exact hold-out per language: the first ceil(holdout * n) records of the shuffle are ``eval``.

    The record at the boundary of each language is found on the keys alone; every row is then
    compared with it, so the texts are never shuffled.
    """
    keyed = corpus.withColumn("digest", digest(*seed, F.col("row_id")))
    cuts = cut_points(keyed, "digest", "row_id", holdout)
    at_or_before = (F.col("digest") < F.col("cut")) | ((F.col("digest") == F.col("cut")) & (F.col("row_id") <= F.col("cut_key")))
    return lookup_join(keyed, cuts, ["lang"]).withColumn(
        "split", F.when(at_or_before, F.lit("eval")).otherwise(F.lit("train"))
    ).drop("cut", "cut_key")


def holdout_union(splits: DataFrame) -> DataFrame:
    """Held-out records of every language; a filter, no shuffle."""
    return splits.where(F.col("split") == "eval")


def number_lines(sentences: DataFrame, hex_digest: str = "digest", out: str = "idx", total: str = "total") -> DataFrame:
    """Index of each line in its language: record shuffle order, then line order."""
    return exact_rank(sentences, ["lang"], hex_digest, ["row_id", "line_no"], out, total)


def shard(sentences: DataFrame, workers: int) -> DataFrame:
    """Contiguous shards of ceil(n / workers) lines per language."""
    per_worker = F.ceil(F.col("total") / F.lit(workers))
    return number_lines(sentences).withColumn(
        "shard_id", F.floor((F.col("idx") - 1) / per_worker).cast("bigint")
    )


def lang_stats(sharded: DataFrame) -> DataFrame:
    """Examples per language and shard, per language, per shard and over all (``total`` / -1)."""
    counts = sharded.groupBy("lang", "shard_id").agg(F.count("*").alias("n"))  # before the cube repeats rows
    return (
        counts.cube("lang", "shard_id").agg(F.sum("n").alias("n"))
        .select(
            F.coalesce("lang", F.lit("total")).alias("lang"),
            F.coalesce("shard_id", F.lit(-1)).cast("bigint").alias("shard_id"),
            "n",
        )
    )


def lang_probs(sentences: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Drawing probability of each language: (n/N)^alpha, normalised; alpha <= 0 is uniform."""
    counts = sentences.groupBy("lang").agg(F.count("*").alias("n"))
    return with_probs(counts, alpha)


def with_probs(counts: DataFrame, alpha: float) -> DataFrame:
    everything = W.partitionBy()  # one row per language
    if alpha <= 0:
        return counts.withColumn("p", F.lit(1.0) / F.count("*").over(everything))
    share = F.pow(F.col("n") / F.sum("n").over(everything), F.lit(float(alpha)))
    return counts.withColumn("_share", share).withColumn(
        "p", F.round(F.col("_share") / F.sum("_share").over(everything), 12)
    ).drop("_share")


def batch_plan(sentences: DataFrame, batch_size: int, alpha: float = 1.0, seed=1234) -> DataFrame:
    """Put every line into a one-language batch and order the batches by language draws.

    Returns the plan over keys: (batch_id, batch_pos, lang, row_id, line_no).

    A language drawn with probability p is a Poisson clock of rate p: its j-th batch arrives at the
    sum of j exponential gaps, and sorting arrivals gives independent draws with p until a language
    runs out, after which the others share the draws. Times are whole micro-ticks, so their sums do
    not depend on the order of addition.
    """
    keys = sentences.select("lang", "row_id", "line_no", digest(seed, "batch", F.col("row_id"), F.col("line_no")).alias("_d"))
    ranked = exact_rank(keys, ["lang"], "_d", ["row_id", "line_no"], "_rn", "n")
    lines = stage(ranked.drop("_d"), "batch-rows").withColumns({  # read three times below
        "_j": F.floor((F.col("_rn") - 1) / F.lit(batch_size)).cast("bigint"),
        "batch_pos": ((F.col("_rn") - 1) % F.lit(batch_size)).cast("bigint"),
    })
    heads = lines.where(F.col("batch_pos") == 0).select("lang", "_j", "n")
    probs = with_probs(heads.where(F.col("_j") == 0).select("lang", "n"), alpha).select("lang", "p")
    gap = F.round(-F.log(uniform(hash32(seed, F.col("lang"), F.col("_j")))) / F.col("p") * F.lit(float(MICRO)))
    timed = running_sum(
        lookup_join(heads.drop("n"), probs, ["lang"], "inner").withColumn("_gap", gap.cast("bigint")),
        ["lang"], F.floor(F.col("_j") / F.lit(TICKS_PER_BUCKET)), ["_j"], "_t", F.col("_gap"),
    )
    order = running_sum(
        timed, [], F.floor(F.col("_t") / F.lit(TICKS_PER_BUCKET * MICRO)), ["_t", "lang", "_j"], "batch_id"
    ).select("lang", "_j", "batch_id")
    return lines.join(order, ["lang", "_j"]).select("batch_id", "batch_pos", "lang", "row_id", "line_no")


def bootstrap(sentences: DataFrame, *seed) -> DataFrame:
    """Draw lines with replacement, per language: as many draws as it has lines, whatever its size.

    The draw table is a list of numbers, spread over the cluster before they are hashed; an index takes 60 bits of
    the hash. Only keys are ranked and joined; the drawn keys then pick their lines, so the texts are never shuffled.
    """
    keys = ["lang", "row_id", "line_no"]
    listed = stage(sentences.select(*keys, "digest"), "keys")
    numbered = number_lines(listed).drop("digest", "total")
    n = F.col("n")
    block = F.lit(DRAW_BLOCK).cast("bigint")
    blocks = (
        listed.groupBy("lang").agg(F.count("*").alias("n"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block))))
        .repartition("lang", "_b")
    )
    draws = (
        blocks.withColumn("draw", F.explode(F.sequence(F.col("_b") * block + 1, F.least(n, (F.col("_b") + 1) * block))))
        .select("lang", "draw", (hash60(*seed, F.col("lang"), F.col("draw")) % n + 1).alias("idx"))
    )
    drawn = numbered.join(draws, ["lang", "idx"]).select(*keys, "draw")
    return lookup_join(sentences.drop("digest"), drawn, keys, "inner")
