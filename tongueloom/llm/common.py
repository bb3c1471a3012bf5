"""What several operators share: bounded Arrow batches, size-checked joins and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tongueloom.session import stage

ARROW_ROWS = "1000"  # rows of one Arrow batch: long texts must fit a Python worker
BROADCAST_ROWS = 100_000  # narrow rows; a table with more of them is shuffled
BROADCAST_CELLS = 1_000_000  # values in arrays of such a table


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner", cells: Column | None = None) -> DataFrame:
    """Join a staged table: broadcast if it is proven small, else a shuffled join that may be split where skewed.

    ``cells`` is the number of values in a row's arrays, so that few rows with long arrays are not taken for small.
    """
    size = table.agg(F.count("*").alias("rows"), F.sum(F.lit(0) if cells is None else cells).alias("cells")).first()
    small = size.rows <= BROADCAST_ROWS and (size.cells or 0) <= BROADCAST_CELLS
    return df.join(F.broadcast(table) if small else table, on, how)


def row_key() -> Column:
    """128 bits that name a row's id and text: rows that share them are copies of one row. A null text counts as empty, a null id as no id."""
    own = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit(""))
    return F.md5(F.concat(own, F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (column names do not differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)``: returns ``(node, root)`` for every linked node.

    Each round hooks every node onto the neighbour of least hash (itself included), follows two
    hooks, and renames the links by the result, so the graph shrinks geometrically whatever its shape. All
    tables stay distributed; each round is written, which cuts the lineage. ``root`` is one node of
    the component, the same for all its nodes. Null ends and self links are ignored.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = stage(hook.select(F.col("a").alias("node"), F.least(rank("a"), "m")["id"].alias("up")), "hooks")
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = stage(hook.join(up, "up").select("node", F.col("top").alias("root")), "roots")
        at = lambda c, r: hook.select(F.col("node").alias(c), F.col("root").alias(r))
        moved = links.join(at("a", "ra"), "a").join(at("b", "rb"), "b").where("ra <> rb")
        links = stage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if names is None:
            names = hook
        else:
            kept = names.join(hook.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            names = stage(kept.select("node", F.coalesce("top", "root").alias("root")), "names")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if names is None else names


def smallest_member(named: DataFrame) -> DataFrame:
    """``(node, root)`` to ``(node, component)``, the component named by its smallest node."""
    least = stage(named.groupBy("root").agg(F.min("node").alias("component")), "least")
    return named.join(least, "root").select("node", "component")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
