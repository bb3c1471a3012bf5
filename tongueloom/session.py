"""Session helpers: the shared work folder, staged tables and size-checked lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 500_000


def build_session(master: str = "local[*]", app: str = "tongueloom", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or where that is unset one below the warehouse, on every master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (where or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives the optimizer true file sizes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash a small input over all cores by its key; an input with enough splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, *by)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets(spark: SparkSession) -> int:
    """How many ways a hot group is cut; follows the session's shuffle width."""
    return 4 * shuffle_width(spark)


def lookup_join(
    df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS, staged: bool = False,
) -> DataFrame:
    """Join a table onto ``df`` (``left`` or ``inner``) whatever the key skew of ``df``.

    The table is staged (unless it comes ``staged``) and counted; up to ``limit`` rows it is
    broadcast. Above that the keys of ``df`` are counted: fewer than P keys can hold more than 1/P of
    the rows, so the table's rows for those are broadcast, and all other rows, now without a hot key,
    meet the rest of the table in a shuffled join.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join cannot do a {how} join")
    table = table if staged else stage(table, "lookup")
    if table.count() <= limit:
        return df.join(F.broadcast(table), keys, how)
    spark = df.sparkSession
    counts = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")), "key-counts")
    share = (counts.agg(F.sum("_n")).first()[0] or 0) / shuffle_width(spark)
    hot = stage(counts.where(F.col("_n") > share).select(*keys), "hot-keys")
    hot_rows = df.join(F.broadcast(hot), keys, "left_semi").join(
        F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return df.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how).unionByName(hot_rows)
