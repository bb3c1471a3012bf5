"""Running sums and ranks that do not put a whole group into one task.

A window partitioned by language would sort one language in one task. Here each group is cut
into ordered buckets: one narrow pass counts them, the small count table is prefix-summed, and
the rows are summed inside ``(group, bucket)``. The count table meets the rows on the very keys
the window is partitioned by, so the join adds no shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tongueloom.functions.hashing import SPAN, hash_word
from tongueloom.session import buckets, lookup_join


def running_sum(
    df: DataFrame, group: list[str], bucket: Column, order: list, out: str, value: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` (default 1: a 1-based rank) in ``order`` within ``group``.

    ``bucket`` must grow with ``order``. ``total`` names an optional column for the group's sum. The
    input is read twice (only its keys the first time), so stage one that is costly to make.
    """
    keys = [*group, "_bucket"]
    df = df.withColumn("_bucket", bucket).withColumn("_value", (F.lit(1) if value is None else value).cast("bigint"))
    in_group = W.partitionBy(*group)
    before = F.sum("_size").over(in_group.orderBy("_bucket")) - F.col("_size")
    sizes = df.groupBy(*keys).agg(F.sum("_value").alias("_size")).select(
        *keys, before.alias("_before"), F.sum("_size").over(in_group).alias(total or "_total")
    )
    if total is None:
        sizes = sizes.drop("_total")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.withColumn("_inside", F.sum("_value").over(inside))
        .join(sizes, keys)
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_value", "_inside", "_before")
    )


def exact_rank(
    df: DataFrame, group: list[str], hex_digest: str, ties: list[str], out: str = "pos", total: str | None = None,
) -> DataFrame:
    """1-based rank by an md5 column, ties by ``ties``; md5 is uniform, so the buckets are even."""
    return running_sum(df, group, _even_bucket(df, hex_digest), [hex_digest, *ties], out, total=total)


def _even_bucket(df: DataFrame, hex_digest: str) -> Column:
    return F.floor(hash_word(F.col(hex_digest)) * F.lit(buckets(df.sparkSession)) / F.lit(SPAN))


def cut_points(keys: DataFrame, hex_digest: str, key: str, share: float) -> DataFrame:
    """(lang, cut, cut_key): digest and key of the record at rank ceil(share * n) of each language.

    Counting buckets shows which one holds that rank; only the rows of that bucket are ranked.
    """
    keys = keys.select("lang", key, hex_digest, _even_bucket(keys, hex_digest).alias("_bucket"))
    in_lang = W.partitionBy("lang")
    sizes = keys.groupBy("lang", "_bucket").agg(F.count("*").alias("_size")).select(
        "lang", "_bucket", "_size", (F.sum("_size").over(in_lang.orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.ceil(F.lit(float(share)) * F.sum("_size").over(in_lang)).cast("bigint").alias("_k"))
    holds = sizes.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_size")))
    near = lookup_join(keys, holds.select("lang", "_bucket", (F.col("_k") - F.col("_before")).alias("_rank")),
                       ["lang", "_bucket"], "inner")
    at = F.row_number().over(W.partitionBy("lang", "_bucket").orderBy(hex_digest, key))
    return near.withColumn("_at", at).where(F.col("_at") == F.col("_rank")).select(
        "lang", F.col(hex_digest).alias("cut"), F.col(key).alias("cut_key"))
