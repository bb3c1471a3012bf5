"""Groups of spelling variants, found with a bit-sliced position index.

The index of a block of words holds, for every position and letter, the set of words with that letter there, as one long integer.
A query word runs over its letters with four such sets at once: the words that have matched without an error so far, and those with
one replaced, one inserted (their positions are shifted by one to the right) or one deleted letter (shifted to the left). A step
handles a machine word's worth of vocabulary per operation.

Blocks come from the words themselves. A key says that all letters outside a window are equal, and that the one error
lies in the window; the first keys have the whole word as window. A key with more words than a block holds is split into the two halves
of its window, and so on down to windows of one letter, so a block has bounded size and each pair meets in exactly one block, the one with
the pair's first differing position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tongueloom.llm.common import attach
from tongueloom.llm.wordhash import grouped
from tongueloom.session import stage

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Variants:
    """Words have ``min_length`` code points and ``min_count`` occurrences; a form has ``ratio`` times the word's; every ``typo``-th run loses a letter.

    ``block``: words of an index, beyond which a key is split. A window of one letter is not split; it can hold all words that are equal but
    for one or two letters.
    """

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    typo: int = 97
    block: int = 8192


# ---- vocabulary --------------------------------------------------------------

def vocabulary(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``(word, n)`` of ``docs(doc_id, text)``: runs of letters, A-Z lower-cased, one letter deleted where the hash of document and run says so.

    A null text has no runs; a null ``doc_id`` is an empty one in the hash.
    """
    doc = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("doc")
    runs = docs.select(doc, F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), 0)).alias("run"))
    hashed = runs.where(F.char_length("run") >= p.min_length).select("run", F.crc32(F.concat("doc", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = hashed.withColumn("at", at).select(F.when(F.col("h") % p.typo == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= p.min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= p.min_count)


# ---- the index ---------------------------------------------------------------

class BitIndex:
    """Sets of words by position and letter, as long integers; bit ``i`` stands for the ``i``-th word."""

    def __init__(self, words: list[str], low: int, high: int):
        """Words of ``size`` or ``size + 1`` letters that differ at the positions ``low`` to ``high`` at most."""
        self.at: list[dict[str, int]] = [{} for _ in range(high + 2)]
        self.of_length: dict[int, int] = {}
        for k in range(low, high + 2):
            places: dict[str, list[int]] = {}
            for i, word in enumerate(words):
                if k < len(word):
                    places.setdefault(word[k], []).append(i)
            self.at[k] = {c: bits(own, len(words)) for c, own in places.items()}
        lengths: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            lengths.setdefault(len(word), []).append(i)
        self.of_length = {n: bits(own, len(words)) for n, own in lengths.items()}
        self.all = (1 << len(words)) - 1

    def near(self, word: str, size: int, low: int, high: int) -> int:
        """The words at exactly one error from ``word``, first differing from it at a position in ``low`` to ``high - 1``.

        ``size`` is the length of the shorter of a pair's words; a window that ends there (``high == size``) has the border after the last letter,
        too. What lies outside the window is equal.
        """
        exact, replaced, longer, shorter = self.all, 0, 0, 0
        own = len(word) == size  # then the others have this length, or one letter more; else one letter less
        for k in range(low, high):
            here = self.at[k].get(word[k], 0)
            if own:
                right = self.at[k + 1].get(word[k], 0)
                opens = exact & ~here
                replaced = (replaced & here) | opens
                longer = (longer | opens) & right
            else:
                left = self.at[k - 1].get(word[k], 0) if k > low else 0
                shorter = (shorter & left) | (exact & ~here)
            exact &= here
        same, more = self.of_length.get(size, 0), self.of_length.get(size + 1, 0)
        if own:
            return (replaced & same) | (longer & more) | (exact & more if high == size else 0)
        shorter &= self.at[high - 1].get(word[high], 0) if high > low else self.all
        return ((shorter | exact) if high == size else shorter) & same


def bits(places: list[int], n: int) -> int:
    out = bytearray(n // 8 + 1)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def members(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def search(words: list[str], counts: list[int], size: int, low: int, high: int) -> Iterator[tuple[str, int, int, str]]:
    """``(word, n_near, best_n, best)`` of the words of a block that have near words in it."""
    index = BitIndex(words, low, high)
    for word in words:
        found = list(members(index.near(word, size, low, high)))
        if found:
            best = min(found, key=lambda i: (-counts[i], words[i]))
            yield word, len(found), counts[best], words[best]


# ---- blocks ------------------------------------------------------------------

def _outside(low: Column, high: Column) -> Column:
    """What a word has outside the window: its first ``low`` letters, and those after ``high``, counted from the end of the shorter word."""
    return F.concat(F.expr("substring(word, 1, low)"), F.lit(" "), F.expr("if(high < size, right(word, size - high), '')"))


def _keyed(windows: DataFrame) -> DataFrame:
    return windows.withColumn("outside", _outside(F.col("low"), F.col("high")))


KEY = ["size", "low", "high", "outside"]


def blocks(vocab: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``(size, low, high, outside, word, n)``: the keys under which words are compared."""
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    open_ = stage(_keyed(vocab.select("word", "n", sizes).withColumns({"low": F.lit(0), "high": F.col("size")})), "windows")
    done: DataFrame | None = None
    while True:
        large = stage(open_.where("high - low > 1").groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > p.block).select(*KEY), "large-keys")
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        fits = attach(open_, large, KEY, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        middle = F.expr("cast((low + high) div 2 as int)")
        halves = F.explode(F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct(middle.alias("l"), F.col("high").alias("h")))).alias("half")
        split = attach(open_, large, KEY, "left_semi").select("word", "n", "size", halves)
        open_ = stage(_keyed(split.select("word", "n", "size", F.col("half.l").alias("low"), F.col("half.h").alias("high"))), "windows")


def nearest(vocab: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``(word, n_near, best_n, best)``: how many words are near, and the one of largest count (ties: the smallest); words without any are absent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, tuple(KEY)):
            rows = pa.Table.from_batches(group)
            if rows.num_rows > 1:
                size, low, high = (rows.column(c)[0].as_py() for c in ("size", "low", "high"))
                found = list(search(rows.column("word").to_pylist(), rows.column("n").to_pylist(), size, low, high))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                        names=["word", "n_near", "best_n", "best"])

    dealt = blocks(vocab, p).repartition(*KEY).sortWithinPartitions(*KEY)
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: forms followed to the last. Counts grow along forms, so there are no cycles; each round doubles the steps."""
    steps = stage(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(attach(steps, ahead, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def spelling_groups(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``, see ``vocabulary``; other columns are ignored.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest count (ties: the smallest
    in code-point order), if that is at least ``ratio`` times the word's own; else null, with a null ``form_n``. ``root`` follows the
    forms to the last. Every row of the table counts, repeated ones too; no rows or no words give an empty result.
    """
    vocab = stage(vocabulary(docs, p), "vocabulary")
    near = stage(nearest(vocab, p), "near-words")
    known = stage(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(F.col("best_n") >= p.ratio * F.col("n"), F.col(c)).alias(name) for c, name in (("best", "form"), ("best_n", "form_n"))]), "forms")
    root = roots(known.where("form is not null"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
