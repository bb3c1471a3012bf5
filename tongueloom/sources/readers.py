"""Readers for per-language text, labelled TSV, CoNLL token files and label lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tongueloom.config import NER_TAGS
from tongueloom.functions.text import LINE_BREAK, strip
from tongueloom.session import lookup_join
from tongueloom.sources.records import BLOCK_LIMIT, places, read_records

# pandas-compatible quoting: doubled quotes inside quoted fields, outer blanks kept
TSV = {
    "sep": "\t", "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _lang_from_path(pattern: str, path: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(F.col(path), pattern, 1)


def read_corpus(spark: SparkSession, path: str, column: str = "input") -> DataFrame:
    """``{lang}_mono.tsv`` files (or folders of parts) under ``path`` -> (lang, row_id, input).

    Quoted fields may hold line breaks; files are split all the same. ``row_id`` is the number of the record in its language, files in
    name order, so a record has the same id however the files are split. Records without a text have a number, but are not returned.
    """
    rows = read_records(spark, f"{path}/*_mono.tsv", TSV, _lang_from_path(r"([^/=]+)_mono\.tsv"))
    return rows.select(F.col("grp").alias("lang"), "row_id", F.col("record")[column].alias("input")).where(F.col("input").isNotNull())


def read_lines(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """``train.<lang>`` files (or folders of parts) -> (lang, file, block, seq, line).

    (file, block, seq) orders the lines of a language; see ``number_file_lines`` for dense numbers.
    """
    return spark.read.text(f"{path}/{{part=,}}{split}.*").select(
        _lang_from_path(rf"[/=]{split}\.([^/]+?)(?:/|$)").alias("lang"),
        *places(), F.col("value").alias("line"),
    )


def number_file_lines(read: DataFrame, group: str = "lang", named: Column | None = None) -> DataFrame:
    """(lang, line_no, line): dense 1-based numbers per language, files in name order.

    ``named`` is the group as an expression of ``file``, worked out once a block; without it the lines have it as a column.

    Sequence numbers are consecutive inside a file block, so a block needs only its first number and
    its offset: one row per block, looked up by the lines; no window over the lines.
    """
    blocks = read.groupBy(*([group] if named is None else []), "file", "block").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    if named is not None:
        read, blocks = read.select("file", "block", "seq", "line"), blocks.withColumn(group, named)
    before = F.sum("_n").over(W.partitionBy(group).orderBy("file", "block")) - F.col("_n")
    blocks = blocks.select(*([] if named is None else [group]), "file", "block", "_first", before.alias("_before"))
    return lookup_join(read, blocks, ["file", "block"], "inner", limit=BLOCK_LIMIT).select(
        group, (F.col("_before") + F.col("seq") - F.col("_first") + 1).alias("line_no"), "line"
    )


def read_labelled(
    spark: SparkSession, path: str, sep: str = "\t", text: str = "news_title", label: str = "label", complete: bool = False,
) -> DataFrame:
    """Labelled file with a header; other columns are tolerated and not returned. Quoted fields may hold line breaks.

    ``complete`` drops rows that miss a value in any column of the file, those not returned included.
    """
    rows = read_records(spark, path, {**TSV, "sep": sep}).select("record.*")
    return (rows.na.drop("any") if complete else rows).select(text, label)


def token_fields(line: Column) -> tuple[Column, Column, Column]:
    """The stripped line, its first blank-separated field, and its last one or ``O`` if there is one field."""
    line = strip(line)
    tag = F.when(F.contains(line, F.lit(" ")), F.substring_index(line, " ", -1)).otherwise(F.lit("O"))
    return line, F.substring_index(line, " ", 1), tag


def parse_conll(lines: DataFrame) -> DataFrame:
    """(file,line_no,line) -> (file,line_no,word,tag) for token lines.

    First and last blank-separated field of the stripped line, tag ``O`` if there is one field; lines
    shorter than two characters are sentence breaks and carry no token.
    """
    line, word, tag = token_fields(F.col("line"))
    return lines.where(F.length(line) >= 2).select("file", "line_no", word.alias("word"), tag.alias("tag"))


def read_conll(spark: SparkSession, path: str, name: str = "^(.*)$") -> DataFrame:
    """Token files -> (file, line_no, line) with dense line numbers per file.

    ``name`` takes the file's name from its path; parts of a folder that share a name count as one file, in name order.
    """
    read = spark.read.text(path).select(*places(), F.col("value").alias("line"))
    return number_file_lines(read, "_group", _lang_from_path(name, "file")).withColumnRenamed("_group", "file")


def read_labels(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(label, label_id): the default tags, or one label a line with ``O`` put first if missing."""
    if path is None:
        return spark.createDataFrame([(t, i) for i, t in enumerate(NER_TAGS)], "label string, label_id bigint")
    listed = F.split(F.regexp_replace("value", f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    whole = spark.read.text(path, wholetext=True).select(listed.alias("ls"))  # one small file, one row
    ls = F.when(F.array_contains("ls", "O"), F.col("ls")).otherwise(F.concat(F.array(F.lit("O")), F.col("ls")))
    return whole.select(F.posexplode(ls).alias("label_id", "label")).select(
        "label", F.col("label_id").cast("bigint")
    )
