"""Sentence cleaning, filters, labels and exact deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from tongueloom.config import LABEL_SETS, MISSING_WORDS
from tongueloom.functions.arrays import label_index
from tongueloom.functions.text import lines, strip, words


def to_sentences(corpus: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(lang,row_id,input) -> (lang,row_id,line_no,line): stripped lines, one row each."""
    return corpus.where(F.col("input").isNotNull()).select(
        "lang", "row_id", *keep, F.posexplode(lines(F.col("input"))).alias("line_no", "line")
    ).withColumns({"line_no": F.col("line_no").cast("bigint"), "line": strip(F.col("line"))})


def min_words(sentences: DataFrame, n: int = 5) -> DataFrame:
    """Training filter: strictly more than ``n`` words."""
    line = F.col("line")
    return sentences.where((F.length(line) > 2 * n) & (F.size(words(line)) > n) & (strip(line) != ""))


def len_window(sentences: DataFrame, lo: int = 5, hi: int = 256) -> DataFrame:
    """Generator filter: at least ``lo`` and fewer than ``hi`` words."""
    line = F.col("line")
    return sentences.where((strip(line) != "") & F.size(words(line)).between(lo, hi - 1))


def drop_missing(df: DataFrame, text: str = "news_title", missing: Sequence[str] = tuple(MISSING_WORDS)) -> DataFrame:
    """Drop rows with a null, or a word that stands for one, in any text column or a null in any other, then rows with a blank text."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    told = reduce(and_, [~F.col(f"`{c}`").isin(list(missing)) for c in texts], F.lit(True))
    return df.na.drop("any").where(told & (strip(F.col(text)) != ""))


def encode_labels(df: DataFrame, labels: Sequence[str] | str, col: str = "label") -> DataFrame:
    """Lower-cased label -> its position in ``labels`` (a list, or the name of one of ``LABEL_SETS``); an unknown label fails the job."""
    return df.withColumn("label_id", label_index(F.lower(F.col(col)), LABEL_SETS[labels] if isinstance(labels, str) else labels))


def dedup(corpus: DataFrame) -> DataFrame:
    """Exact distinct ``input`` inside a language, keeping the smallest ``row_id``.

    A plain aggregate: copies of a hot text collapse before the shuffle.
    """
    return corpus.groupBy("lang", "input").agg(F.min("row_id").alias("row_id")).select("lang", "row_id", "input")


def concat_corpora(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack corpora of several sources into one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
