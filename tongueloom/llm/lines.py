"""Repeated passages of lines, found by winnowing.

Lines are hashed as the words they hold, so that a passage is found also where it begins or ends inside a line. Every run of ``min_words``
words is a window of overlapping grams of ``gram`` words; the gram of least hash is the window's fingerprint, so two equal windows
have a fingerprint in common wherever they stand. Positions that share a fingerprint are joined: the windows that have it reach from it to either side, and
are compared as one segment, or, where segments differ, one by one, so that a match extends both ways to its full length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tongueloom.llm.common import attach, unused
from tongueloom.llm.wordhash import Words, keys, mix, slices
from tongueloom.operators.lm import maybe_among
from tongueloom.session import stage

_BLOCK = 8  # windows compared first by the words that they have in common
_BITS = 16  # bits a core in the filter of shared cores, of which there are 2**28 at most (32 MB)
_PLACE = np.uint64((1 << 28) - 1)  # bits of a word's place in texts worked on together; the others are of a hash


@dataclass(frozen=True)
class LineDedup:
    """A passage is deleted if it holds at least ``min_words`` words and occurred before. ``gram`` changes no result."""

    min_words: int = 50
    gram: int = 10
    seed: int = 3


def run_hashes(values: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of every ``size`` consecutive values, from hashes of runs of doubled length; the last two overlap."""
    n = 1
    while n < size and len(values):
        more = min(n, size - n)
        values = mix(values[:-more] * odd + values[more:])
        n += more
    return values


def run_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    n = 1
    while n < size and len(values):
        more = min(n, size - n)
        values = np.minimum(values[:-more], values[more:])
        n += more
    return values


class Windows:
    """The windows of some texts: where each starts, which text it is of, and the place and hash of its fingerprint.

    The hash's upper bits decide which gram is the least, the place decides between equal ones: relative places are the same in equal windows.
    """

    def __init__(self, texts: list[bytes], p: LineDedup):
        words = Words([t.lower() for t in texts])
        self.hashes, self.bounds, self.p = words.hashes, words.bounds, p
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        n = max(0, len(self.hashes) - p.min_words + 1)
        starts = np.arange(n)
        self.starts = starts[self.bounds[self.owner[:n] + 1] - starts >= p.min_words]
        gram, odd = min(p.gram, p.min_words), keys(1, p.seed)[0] | np.uint64(1)
        grams = run_hashes(self.hashes, gram, odd)[: n + p.min_words - gram] if n else np.zeros(0, dtype=np.uint64)
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        self.place = (run_minima(ranked, p.min_words - gram + 1)[self.starts] & _PLACE).astype(np.int64)
        self.grams = grams

    def content(self) -> np.ndarray:
        return run_hashes(self.hashes, self.p.min_words, keys(1, self.p.seed + 1)[0] | np.uint64(1))[self.starts]

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The block of each window, and a hash of the words that all windows of a block have in common.

        A block is up to ``_BLOCK`` consecutive windows of a fingerprint, counted from it, so that equal windows lie in blocks of equal words.
        """
        size, odd = min(_BLOCK, self.p.min_words), keys(1, self.p.seed + 3)[0] | np.uint64(1)
        block = (self.place - self.starts) // size
        common = run_hashes(self.hashes, self.p.min_words - size + 1, odd)[self.place - block * size]
        return block, mix(mix(common * odd + self.grams[self.place]) + block.astype(np.uint64))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))  # rows without an id come last


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def segments(docs: DataFrame, p: LineDedup) -> DataFrame:
    """``(doc_id, row, lo, n, mark, seg)``: each fingerprint of a text with the ``n`` windows that have it, the first one at word ``lo``.

    ``seg`` is a hash of all their words. ``row`` is a hash of the text, so that rows which repeat an id stay apart; a row without an id has the
    largest one.
    """
    odd = keys(1, p.seed + 2)[0] | np.uint64(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            w = Windows(texts, p)
            first = np.flatnonzero(np.diff(w.place, prepend=-1))
            n = np.diff(np.append(first, len(w.place)))
            content, lo = w.content(), w.starts[first]
            own = w.owner[lo]
            seg = mix(mix(content[first] * odd + content[first + n - 1]) + n.astype(np.uint64))  # the two overlap, so they hold every word
            yield pa.RecordBatch.from_arrays(
                [pa.array(_numbers(batch, "doc_id")[own]), pa.array(_numbers(batch, "row")[own]), pa.array((lo - w.bounds[own]).astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(w.grams[w.place[first]].view(np.int64)), pa.array(seg.view(np.int64))],
                names=["doc_id", "row", "lo", "n", "mark", "seg"])

    return docs.mapInArrow(run, "doc_id long, row long, lo int, n int, mark long, seg long")


def windows_of(docs: DataFrame, p: LineDedup) -> DataFrame:
    """``(doc_id, row, lo, mark, core, contents)``: the windows of the row's ``segs`` (first words and numbers of windows), a row for each block.

    ``lo`` is the first word of the block's first window, ``core`` the hash of the words that its windows have in common.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            w = Windows(texts, p)
            edges = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            for start, segs in zip(w.bounds.tolist(), batch.column("segs")):
                lo, n = (segs.values.field(k).to_numpy() for k in ("lo", "n"))
                edges += np.bincount(start + lo, minlength=len(edges)) - np.bincount(start + lo + n, minlength=len(edges))
            take = np.cumsum(edges)[w.starts] > 0
            block, core = w.blocks()
            place, block, content = w.place[take], block[take], w.content()[take]
            first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            lo = w.starts[take][first]
            own = w.owner[lo]
            contents = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)).astype(np.int32)), pa.array(content.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_numbers(batch, "doc_id")[own]), pa.array(_numbers(batch, "row")[own]), pa.array((lo - w.bounds[own]).astype(np.int32)),
                 pa.array(w.grams[place[first]].view(np.int64)), pa.array(core[take][first].view(np.int64)), contents],
                names=["doc_id", "row", "lo", "mark", "core", "contents"])

    return docs.mapInArrow(run, "doc_id long, row long, lo int, mark long, core long, contents array<long>")


def _firsts(found: DataFrame, on: list[str], name: str) -> DataFrame:
    """Where each thing that occurs more than once occurs first."""
    first = found.groupBy(*on).agg(F.min(F.struct("doc_id", "row", "lo")).alias("first"), F.count("*").alias("times"))
    return stage(first.where("times > 1").select(*on, *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "row", "lo")]), name)


def _with_shared_core(blocks: DataFrame) -> DataFrame:
    """The blocks whose ``core`` other blocks have, and few others: a filter of bounded size, so blocks with their contents do not move for it."""
    shared = stage(blocks.groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select("core"), "shared-cores")
    bits = min(1 << 28, max(1 << 15, 1 << (_BITS * shared.count()).bit_length()))
    return maybe_among(blocks, shared, "core", bits, F.col("core").bitwiseAND(F.lit(2**63 - 1)))


_IS_FIRST = "(first_doc_id is null or (doc_id = first_doc_id and row = first_row and lo = first_lo))"


def repeated_windows(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``(doc_id, row, segs)``: per row the windows that repeat an earlier one (smaller doc_id, then smaller ``row``, then place).

    Segments are compared whole first: all windows of one that occurred before are repeats. Windows are compared one by one only where
    differing segments share a fingerprint, at the borders of passages, and there in the first occurrence of each segment. A block of windows
    whose common words occur nowhere else has no repeats and nearly always goes before that; one that stays is told by its windows.
    """
    keyed = docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    found = stage(segments(keyed, p), "segments")
    marks = stage(found.groupBy("mark").agg(F.count("*").alias("times"), F.min("seg").alias("low"), F.max("seg").alias("high"))
                  .where("times > 1").select("mark", (F.col("low") != F.col("high")).alias("differ")), "marks")
    again = stage(attach(found, marks, ["mark"]), "segments-again")
    firsts = _firsts(again, ["mark", "seg"], "first-segments").hint("merge")  # one form at all sizes, so what moves grows as the input
    told = stage(again.join(firsts, ["mark", "seg"], "left"), "told")
    span = F.struct("lo", "n")
    edges = stage(told.where(f"differ and {_IS_FIRST}").groupBy("doc_id", "row").agg(F.collect_set(span).alias("segs")), "borders")
    blocks = stage(windows_of(attach(keyed, edges, ["doc_id", "row"], cells=F.size("segs")), p), "blocks")
    windows = stage(_with_shared_core(blocks).select("doc_id", "row", "mark", "lo", F.posexplode("contents").alias("at", "content"))
                    .select("doc_id", "row", (F.col("lo") + F.col("at")).alias("lo"), "mark", "content"), "windows")
    on = ["mark", "content"]
    singles = attach(windows, _firsts(windows, on, "first-windows"), on).where(f"not {_IS_FIRST}")
    gone = told.where(f"not {_IS_FIRST}").select("doc_id", "row", "lo", "n").unionByName(singles.select("doc_id", "row", "lo", F.lit(1).alias("n")))
    return gone.groupBy("doc_id", "row").agg(F.collect_set(span).alias("segs"))


def cut(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, list[int], int]:
    """The text without the words from ``starts`` up to ``ends``, the numbers of the lines that go whole, and how many words go."""
    raw = text.encode()
    words = Words([raw])
    edges = np.bincount(starts, minlength=len(words.starts) + 1) - np.bincount(ends, minlength=len(words.starts) + 1)
    gone = np.cumsum(edges)[:-1] > 0
    lines = raw.split(b"\n")
    breaks = np.cumsum([len(x) + 1 for x in lines])
    line_of = np.searchsorted(breaks, words.starts, side="right")
    at = np.searchsorted(line_of, np.arange(len(lines) + 1))  # the words of a line
    padded = np.concatenate(([False], gone, [False]))
    kept = np.concatenate(([0], np.cumsum(~gone)))
    out, removed = [], []
    for k, line in enumerate(lines):
        a, b = int(at[k]), int(at[k + 1])
        left = int(kept[b] - kept[a])
        if left == b - a and (b > a or not (padded[a] and padded[a + 1])):
            out.append(line)
        elif not left:
            removed.append(k)
        else:
            start = int(breaks[k]) - len(line) - 1
            begin = [start, *words.starts[a + 1: b].tolist()]  # a word goes with the blanks after it
            end = [*words.starts[a + 1: b].tolist(), start + len(line)]
            part = b"".join(raw[i:j] for i, j, g in zip(begin, end, gone[a:b].tolist()) if not g)
            out.append(part.rstrip() if gone[b - 1] else part)
    return b"\n".join(out).decode(), removed, int(gone.sum())


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its repeated passages, and ``n_lines``, ``removed`` (numbers from 0 of the lines that
    go whole), ``n_cut`` (words that go, those of whole lines included).

    Words are runs without ASCII white space; case (A-Z), spacing and line breaks do not count. A word goes if ``min_words`` consecutive words around
    it occurred before, in another text or this one; the first occurrence, by ``(doc_id, place)``, stays. Shorter repeats stay, however often they occur. A line
    without words left goes, also a blank one between words that go; of other lines the words that go are cut with the blanks after them. Lines end at ``\\n``.
    A null text stays null and has no lines; an empty text has one, blank. Rows without a ``doc_id`` come after all others. Rows that repeat a ``doc_id`` are
    matched each by its own text, in the order of a hash of it; copies of a row, id and text, count as one. Columns named
    ``n_lines``, ``removed`` or ``n_cut`` are replaced.
    """
    docs = docs.drop("n_lines", "removed", "n_cut")
    key, row, found = (unused(docs, c) for c in ("own_id", "own_row", "gone_windows"))
    gone = stage(repeated_windows(docs, p).toDF(key, row, found), "gone")
    rows = docs.withColumns({key: _id(), row: F.xxhash64("text")}).join(gone.hint("merge"), [key, row], "left").select(*docs.columns, found)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, count, n_cut = batch.column("text").to_pylist(), [], [], []
            for i, (text, own) in enumerate(zip(texts, batch.column(found))):
                count.append(0 if text is None else text.count("\n") + 1)
                lost, n = [], 0
                if own.is_valid:
                    lo, size = (own.values.field(c).to_numpy() for c in ("lo", "n"))
                    texts[i], lost, n = cut(text, lo, lo + size - 1 + p.min_words)
                removed.append(lost)
                n_cut.append(n)
            columns = [pa.array(texts, type=pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(count, type=pa.int64()), pa.array(removed, type=pa.list_(pa.int32())), pa.array(n_cut, type=pa.int64())],
                names=[*names, "n_lines", "removed", "n_cut"])

    schema = docs.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "removed": F.array().cast("array<int>"), "n_cut": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(run, schema)
