"""Experiment grids and summaries over seeds and checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def grid(langs: DataFrame, seeds: Sequence[int], tasks: Sequence[str]) -> DataFrame:
    """Every (task, lang, seed) once, however often a language is listed."""
    return (
        langs.select("lang").distinct()
        .withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .select("task", "lang", F.col("seed").cast("bigint"))
    )


def summarise(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Mean and spread over seeds per (task, lang), per task and overall.

    Each seed counts once: its runs are averaged first.
    """
    per_seed = metrics.groupBy("task", "lang", "seed").agg(F.avg(value).alias("v"))
    return (
        per_seed.groupingSets([["task", "lang"], ["task"], []], "task", "lang")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
        .select(F.coalesce("task", F.lit("all")).alias("task"), F.coalesce("lang", F.lit("all")).alias("lang"),
                "n", "mean", "std")
    )


def by_step(metrics: DataFrame) -> DataFrame:
    """Metrics of several checkpoints under ``{step}_{key}``, with the best step of each (task, lang, key).

    (task, lang, step, key, value) in; best = highest value, earliest step on ties.
    """
    best = F.min(F.struct((-F.col("value")).alias("neg"), F.col("step").alias("step"))).alias("b")
    # one row per (task, lang, key): an aggregate next to the rows it came from
    top = metrics.groupBy("task", "lang", "key").agg(best).select("task", "lang", "key", F.col("b.step").alias("best_step"))
    return metrics.join(top, ["task", "lang", "key"]).select(
        "task", "lang", F.concat_ws("_", F.col("step").cast("string"), "key").alias("name"), "value",
        (F.col("step") == F.col("best_step")).cast("int").alias("is_best"),
    )
