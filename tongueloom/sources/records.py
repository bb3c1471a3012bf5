"""Records of delimited files whose quoted fields hold line breaks, read in splits.

A line alone does not tell whether it starts a record: that depends on whether a quote is open where it starts. So each line is taken as a
map from the state before it (outside quotes, inside) to the state after it. Maps compose, so the state before every line follows from
running compositions inside its block of the file, and from one row per block for what came before. Lines meet in the block they were read
from; only records that cross the border of two blocks are put together in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tongueloom.session import lookup_join

BLOCK_LIMIT = 2_000_000  # file blocks broadcast at most; a few hundred bytes each
_MIDDLE, _INSIDE, _CLOSED, _START = 0, 1, 2, 3  # in an unquoted field, in quotes, after a quote met in quotes, before a field


def places() -> list[Column]:
    """Where a row was read: its file, the block of the file, and a number that is consecutive inside a block."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq")]


def state_after(line: Column, inside: int, sep: str) -> Column:
    """1 if a quote is open after the line, which starts inside quotes or at a field.

    A quote opens at the start of a field only; two quotes inside quotes are one character.
    """
    const = lambda v: F.lit(v)

    def over_text(state: Column, text: Column) -> Column:
        return F.when((text == "") | (state == _INSIDE), state).when(text.endswith(sep), const(_START)).otherwise(const(_MIDDLE))

    def over_quote(state: Column) -> Column:
        return F.when(state == _START, const(_INSIDE)).when(state == _INSIDE, const(_CLOSED)).when(
            state == _CLOSED, const(_INSIDE)).otherwise(state)

    parts = F.split(line, '"', -1)
    first = over_text(const(_INSIDE if inside else _START), parts[0])
    end = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first, lambda s, t: over_text(over_quote(s), t))
    return F.when(~F.contains(line, F.lit('"')), F.lit(inside)).otherwise((end == _INSIDE).cast("int"))


def composed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``b0``, ``b1``, ``a0``, ``a1``: the state before and after each row, if the group is entered outside or inside quotes.

    ``e0``, ``e1`` hold each row's own map. A row with ``e0 = e1`` sets the state, one that swaps them turns it over; so the state is the last one
    set, turned over as often as swaps followed.
    """
    upto = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    flip = lambda state, times: (state + times) % 2
    df = df.withColumn("_turns", F.sum((F.col("e0") > F.col("e1")).cast("int")).over(upto))
    df = df.withColumn("_set", F.last(F.when(F.col("e0") == F.col("e1"), flip(F.col("e0"), F.col("_turns"))), ignorenulls=True).over(upto))
    near = W.partitionBy(*group).orderBy(*order)
    for k in (0, 1):
        df = df.withColumn(f"a{k}", flip(F.coalesce("_set", F.lit(k)), F.col("_turns")).cast("int"))
        df = df.withColumn(f"b{k}", F.lag(f"a{k}", 1, k).over(near))
    return df.drop("_turns", "_set")


def _lines(spark: SparkSession, path: str, group: Column, sep: str) -> DataFrame:
    """Physical lines in their blocks, with ``run0`` and ``run1``: how many records have started in the block, by how it is entered."""
    read = spark.read.option("lineSep", "\n").text(path).select(group.alias("grp"), *places(), F.col("value").alias("line"))
    read = read.withColumns({"e0": state_after(F.col("line"), 0, sep), "e1": state_after(F.col("line"), 1, sep), "blank": F.col("line").isin("", "\r")})
    out = composed(read, ["file", "block"], ["seq"])
    upto = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in (0, 1):
        out = out.withColumn(f"run{k}", F.sum(((F.col(f"b{k}") == 0) & ~F.col("blank")).cast("int")).over(upto))
    return out


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: how it is entered and left, its records, and those before it in its file and in its group (headers not counted)."""
    last = F.max_by(F.struct("a0", "a1", "run0", "run1"), "seq").alias("z")
    each = lines.groupBy("grp", "file", "block").agg(last).select(
        "grp", "file", "block", F.col("z.a0").alias("e0"), F.col("z.a1").alias("e1"), F.col("z.run0").alias("n0"), F.col("z.run1").alias("n1"))
    each = composed(each, ["file"], ["block"]).select(
        "grp", "file", "block", F.col("b0").alias("entered"), F.col("a0").alias("left"), F.when(F.col("b0") == 0, F.col("n0")).otherwise(F.col("n1")).alias("n"))
    in_file = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    each = each.withColumn("in_file", in_file).withColumn("heads", ((F.col("in_file") == 0) & (F.col("n") > 0)).cast("int"))
    order = W.partitionBy("grp").orderBy("file", "block")
    return each.select("file", "block", "entered", "left", "n", "in_file",
                       (F.sum("n").over(order) - F.col("n") - F.sum("heads").over(order)).alias("in_group"))


def read_records(spark: SparkSession, path: str, options: dict, group: Column | None = None) -> DataFrame:
    """``(grp, row_id, record)``: the records of delimited files with a header each, numbered from 1 in each group, files in name order.

    ``record`` is a struct of the columns that the first file's header names. Numbers do not depend on how files are split. Blank lines outside
    quotes are no records. A file's block is one task's work, as in any read of text.
    """
    sep = options.get("sep", "\t")
    columns = spark.read.options(**options).csv(path).columns
    lines = _lines(spark, path, F.lit("") if group is None else group, sep)
    own = lambda c: F.when(F.col("entered") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    placed = lookup_join(lines, _blocks(lines), ["file", "block"], "inner", limit=BLOCK_LIMIT)
    placed = placed.withColumn("run", own("run")).where(((own("b") == 1) | ~F.col("blank")) & (F.col("in_file") + F.col("run") > 1))
    border = (F.col("run") == 0) | ((F.col("left") == 1) & (F.col("run") == F.col("n")))
    text_of = lambda rows: F.array_join(F.array_sort(rows)["text"], "\n")
    pieces = placed.groupBy("grp", "file", "block", (F.col("in_group") + F.col("run")).cast("bigint").alias("row_id"), border.alias("border")).agg(
        text_of(F.collect_list(F.struct("seq", F.col("line").alias("text")))).alias("text"))
    whole = pieces.where(~F.col("border")).select("grp", "row_id", "text")
    joined = pieces.where("border").groupBy("grp", "row_id").agg(text_of(F.collect_list(F.struct("file", "block", "text"))).alias("text"))
    record = F.from_csv(F.regexp_replace("text", "\r$", ""), _ddl(columns),
                        {k: str(v).lower() if isinstance(v, bool) else v for k, v in {**options, "header": False, "multiLine": True}.items()})
    return whole.unionByName(joined).select("grp", "row_id", record.alias("record"))


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
