"""Alignment of two tokenizers' tokens on the same text.

Both tokenizers give sorted lists of byte offsets where their tokens end. The shorter list drives a galloping search into the longer one:
from a first guess the step doubles until the offset is bracketed, then the bracket is halved. Offsets found in both lists cut the tokens
into groups, and the ranks of a token's two ends differ by the range of tokens of the other side that it overlaps. All documents of a
chunk are searched side by side.

Texts are encoded once and their ids staged. Counts of id pairs come from a first pass over the ids. The second pass has the pairs of largest count at hand, at most ``hot`` of
them, whatever the corpus; the links of other pairs are joined with their counts in Spark.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tongueloom.llm.bytebpe import units
from tongueloom.llm.common import attach, prepare
from tongueloom.llm.wordhash import chunks as byte_chunks, slices
from tongueloom.session import stage

MARK = "▁"
CHUNK_BYTES = 250_000  # bytes of text, or of ids, aligned together; a longer text is one chunk
_LONG = 64  # longer words are not remembered


@dataclass(frozen=True)
class Pairing:
    """``first``: a byte-level file of the tokenizers library, ``second``: a sentencepiece model, both on every worker.

    ``hot``: pairs looked up in memory; ``cache``: words whose ids a worker remembers; ``buffer``: pairs counted in memory at a time.
    Neither changes a result.
    """

    first: str
    second: str
    hot: int = 1_000_000
    cache: int = 100_000
    buffer: int = 1_000_000


# ---- tokens ------------------------------------------------------------------

def shown_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, letters from 256 on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class TokenPair:
    """Ids of words by both tokenizers. Neither joins tokens over a single blank between words, so a text's ids are its words' ids in a row."""

    def __init__(self, p: Pairing):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own cost it memory
        self.a = Tokenizer.from_file(p.first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=p.second)
        letters = shown_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(self.b.get_piece_size())]
        self.blank = self.b.piece_to_id(MARK)
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.limit = p.cache
        self.names: list[bytes] | None = None
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple[bytes, bytes, bool]] = {}

    def _both(self, new: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Ids of words by either tokenizer, and whether both spell blank + word."""
        raw = [(" " + u).encode() for u in new]
        found_a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        found_b = [x if u else [self.blank] for u, x in zip(new, self.b.encode(new, num_threads=1))]
        size, good, sides = np.fromiter(map(len, raw), np.int64, len(raw)), np.ones(len(new), dtype=bool), []
        for found, spelt, length in ((found_a, self.bytes_a, self.length_a), (found_b, self.bytes_b, self.length_b)):
            stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(stop[-1]))
            upto = np.concatenate(([0], np.cumsum(length[ids])))
            same = np.diff(upto[stop], prepend=0) == size
            if not same.all() or b"".join(map(spelt.__getitem__, ids.tolist())) != b"".join(raw):
                same &= [b"".join(map(spelt.__getitem__, x)) == r for x, r in zip(found, raw)]
            good &= same
            flat, edge = ids.tobytes(), [0, *(4 * stop).tolist()]
            sides.append([flat[i:j] for i, j in zip(edge, edge[1:])])
        return zip(*sides, good.tolist())

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of blank + text by either tokenizer, as 32-bit integers; none for an empty text, or one that is not spelt back by both."""
        cut = []
        for raw in texts:
            try:
                cut.append(units(raw.decode()) if raw else [])
            except UnicodeDecodeError:
                cut.append([])
        if len(self.words) > self.limit:
            self.words.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.words))
        if new:
            self.words.update(zip(new, self._both(new)))
        out = []
        for own in cut:
            a, b, good = zip(*map(self.words.__getitem__, own)) if own else ((), (), ())
            out.append((b"".join(a), b"".join(b)) if all(good) else (b"", b""))
        for unit in new:
            if len(unit) > _LONG:
                del self.words[unit]
        return out

    def named(self) -> list[bytes]:
        """Every id in decimal behind each of the four separators: of groups, of tokens of the first, between the sides, of tokens of the second."""
        if self.names is None:
            n = max(self.n_a, self.n_b)
            self.names = [sep + b"%d" % i for sep in (b";", b",", b"|", b",") for i in range(n)]
        return self.names


# ---- galloping ---------------------------------------------------------------

def gallop(values: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For every value how many entries of the sorted ``long`` are smaller, searched from ``guess`` in doubling steps, then by halving.

    Every value must be at most the largest entry.
    """
    low = np.clip(guess, 0, len(long) - 1)
    high = low.copy()  # the answer lies in low..high in the end
    step = np.ones(len(values), dtype=np.int64)
    up = long[low] < values
    moving = np.flatnonzero(up)
    while len(moving):
        low[moving] = high[moving] + 1
        high[moving] = np.minimum(high[moving] + step[moving], len(long) - 1)
        step[moving] *= 2
        moving = moving[long[high[moving]] < values[moving]]
    moving = np.flatnonzero(~up & (low > 0))
    while len(moving):
        nxt = np.maximum(low[moving] - step[moving], 0)
        step[moving] *= 2
        still = long[nxt] >= values[moving]
        high[moving] = np.where(still, nxt, high[moving])
        low[moving] = np.where(still, nxt, nxt + 1)
        moving = moving[still & (nxt > 0)]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < values[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``count[0]`` of them, then the same for the next."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - count - first, count)


@dataclass
class Aligned:
    """Tokens of a chunk's documents aligned: common ends as token numbers (``cut_a``, ``cut_b``), links as token numbers (``link_a``, ``link_b``)."""

    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> Aligned:
    """``ends``: where tokens end in the chunk's bytes, ``doc``: tokens before each document, and the sum. In each document the side with fewer tokens searches."""
    n_a, n_b = np.diff(doc_a), np.diff(doc_b)
    parts = []
    for flipped in (False, True):
        short, long, at, other = (ends_b, ends_a, doc_b, doc_a) if flipped else (ends_a, ends_b, doc_a, doc_b)
        own = np.flatnonzero((n_b < n_a) if flipped else (n_a <= n_b) & (n_a > 0))
        size, span = np.diff(at)[own], np.diff(other)[own]
        token = _ranges(at[own], size)
        if not len(token):
            continue
        place = token - np.repeat(at[own], size)
        guess = np.repeat(other[own], size) + place * np.repeat(span, size) // np.repeat(size, size)
        rank = gallop(short[token], long, guess)
        hit = long[rank] == short[token]
        # the first token of the other side that a token overlaps: the one after the previous end, if that is a common end
        before = np.concatenate(([0], (rank + hit)[:-1]))
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        before[start] = other[own]
        count = rank - before + 1
        pair = (np.repeat(token, count), _ranges(before, count))
        cut = (token[hit], rank[hit])
        parts.append((*(cut[::-1] if flipped else cut), *(pair[::-1] if flipped else pair)))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return Aligned(none, none, none, none)
    cut_a, cut_b, link_a, link_b = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.argsort(cut_a, kind="stable")
    by = np.argsort(link_a, kind="stable")
    return Aligned(cut_a[order], cut_b[order], link_a[by], link_b[by])


class Chunk:
    """The aligned tokens of several texts, from the ids that ``encode`` gives."""

    def __init__(self, pair: TokenPair, ids: list[tuple[bytes, bytes]]):
        self.pair = pair
        self.a, self.b = (np.frombuffer(b"".join([x[k] for x in ids]), dtype=np.int32).astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) // 4 for x in ids], dtype=np.int64) for k in (0, 1))
        self.at_a, self.at_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        self.aligned = align(np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b]), self.at_a, self.at_b)
        x = self.aligned
        self.n_groups = self._per_doc(x.cut_a)
        self.n_links = self._per_doc(x.link_a)
        self.links = self.a[x.link_a] * pair.n_b + self.b[x.link_b]

    def _per_doc(self, tokens_a: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(tokens_a, self.at_a))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, pair, links)`` of each distinct pair of a document; a pair is its first id * 2**32 + its second."""
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        own, times = np.unique(doc * (self.pair.n_a * self.pair.n_b) + self.links, return_counts=True)
        doc, pair = np.divmod(own, self.pair.n_a * self.pair.n_b)
        first, second = np.divmod(pair, self.pair.n_b)
        return doc, (first << 32) + second, times

    def groups(self) -> list[bytes]:
        """Per document the text of its groups: ``a1,a2|b1;a3|b2,b3`` in decimal ids."""
        x, n = self.aligned, max(self.pair.n_a, self.pair.n_b)
        begin_a = np.zeros(len(self.a), dtype=bool)
        begin_b = np.zeros(len(self.b), dtype=bool)
        for begin, cut in ((begin_a, x.cut_a), (begin_b, x.cut_b)):
            begin[:1] = True
            begin[cut[:-1] + 1] = True
        code_a = self.a + n * np.where(begin_a, 0, 1)
        code_b = self.b + n * np.where(begin_b, 2, 3)
        group_a, group_b = np.cumsum(begin_a) - 1, np.cumsum(begin_b) - 1
        # a token's place among all: those of its side before it, and those of the other side in groups before its own (for the second side: up to its own)
        size_a, size_b = np.bincount(group_a, minlength=len(x.cut_a)), np.bincount(group_b, minlength=len(x.cut_a))
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        out[np.arange(len(self.a)) + (upto_b - size_b)[group_a]] = code_a
        out[np.arange(len(self.b)) + upto_a[group_b]] = code_b
        names, edge = self.pair.named(), (self.at_a + self.at_b).tolist()
        codes = out.tolist()
        return [b"".join(map(names.__getitem__, codes[i:j]))[1:] for i, j in zip(edge, edge[1:])]


_loaded: dict[Pairing, TokenPair] = {}


def loaded(p: Pairing) -> TokenPair:
    if p not in _loaded:
        _loaded.clear()
        _loaded[p] = TokenPair(p)
    return _loaded[p]


# ---- Spark -------------------------------------------------------------------

def tokens(docs: DataFrame, p: Pairing) -> DataFrame:
    """``(doc_id, a, b)``: the ids of every row of ``docs(doc_id, text)`` by either tokenizer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(p)
        try:
            for batch, texts in slices(batches, "text", CHUNK_BYTES):
                ids = pair.encode(texts)
                lists = [_lists([x[k] for x in ids]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *lists], names=["doc_id", "a", "b"])
        finally:
            pair.forget()  # a worker lives on and goes to other operators

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a array<int>, b array<int>")


def _lists(flat: list[bytes]) -> pa.ListArray:
    edge = np.concatenate(([0], np.cumsum([len(x) // 4 for x in flat]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32)))


def _chunks(pair: TokenPair, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Rows of ``tokens`` a chunk at a time."""
    for batch in batches:
        sides = []
        for name in ("a", "b"):
            lists = batch.column(name)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            edge = [0, *np.cumsum(4 * lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
            sides.append([flat[i:j] for i, j in zip(edge, edge[1:])])
        ids = list(zip(*sides))
        for i, j in byte_chunks([x[0] + x[1] for x in ids], 4 * CHUNK_BYTES):
            yield batch.slice(i, j - i), Chunk(pair, ids[i:j])


def pair_counts(ids: DataFrame, p: Pairing) -> DataFrame:
    """``(pair, n)``: in how many rows of ``tokens`` an id pair is linked; ``pair`` is first id * 2**32 + second id."""

    def counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["pair", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, waiting, size = loaded(p), [], 0
        for _, c in _chunks(pair, batches):
            waiting.append(c.distinct()[1])
            size += len(waiting[-1])
            if size > p.buffer:
                yield counted(waiting)
                waiting, size = [], 0
        if size:
            yield counted(waiting)

    return ids.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """``(pair, n, best)``: whether the count is the highest of its first id. The highest counts are at most one row per first id."""
    first = F.shiftright("pair", 32)
    top = stage(counts.groupBy(first.alias("a")).agg(F.max("n").alias("top")), "top-counts")
    return attach(counts.withColumn("a", first), top, ["a"]).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def hottest(counts: DataFrame, limit: int) -> int:
    """The least count from which on at most ``limit`` pairs have it, from a histogram of some hundred bins."""
    low = F.expr("cast(floor(log2(n) * 8) as int)")
    bins = counts.groupBy(low.alias("bin")).agg(F.count("*").alias("rows"), F.max("n").alias("top")).orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for row in bins:
        total += row.rows
        if total > limit:
            return row.top + 1 if least is None else least
        least = counts_from(row.bin)
    return 0


def counts_from(bin_: int) -> int:
    """The least whole number of a bin, or a smaller one that no bin above holds."""
    n = max(1, int(2 ** (bin_ / 8)) - 1)
    while int(np.floor(np.log2(n) * 8)) < bin_:
        n += 1
    return n


def scored(ids: DataFrame, p: Pairing, known: Broadcast) -> DataFrame:
    """The rows of ``tokens`` with their columns, sums over the hot pairs, and the pairs that are not hot with their numbers of links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (hot, count, best) = loaded(p), known.value
        for batch, c in _chunks(pair, batches):
            doc, own, times = c.distinct()
            at = np.minimum(np.searchsorted(hot, own), max(len(hot) - 1, 0))
            hit = hot[at] == own if len(hot) else np.zeros(len(own), dtype=bool)
            sums = [np.bincount(doc[hit], weights=w, minlength=batch.num_rows).astype(np.int64) for w in (
                times[hit] * best[at[hit]], times[hit] * count[at[hit]])]
            cold_doc, cold, cold_times = doc[~hit], own[~hit], times[~hit]
            edge = pa.array(np.searchsorted(cold_doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in c.groups()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (c.n_a, c.n_b, c.n_groups, c.n_links, *sums)),
                 pa.array(sha, type=pa.string()), pa.ListArray.from_arrays(edge, pa.array(cold)), pa.ListArray.from_arrays(edge, pa.array(cold_times))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "cold", "times"])

    return ids.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, cold array<long>, times array<long>")


def alignments(docs: DataFrame, p: Pairing) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs(doc_id, text)``; other columns are ignored.

    A pair's count is the number of rows that hold it linked: rows that repeat an id or a text count one by one, and each is returned. Null
    and empty texts, and those that a tokenizer does not spell back, have zeros and an empty ``groups_sha256``. A null ``doc_id``
    stays null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids = stage(tokens(docs, p), "token-pairs")
    counts = stage(with_best(stage(pair_counts(ids, p), "pair-counts")), "pair-bests")
    rows = counts.where(F.col("n") >= hottest(counts, p.hot)).toArrow()  # at most ``hot`` rows
    hot = rows.column("pair").to_numpy()
    order = np.argsort(hot)
    known = spark.sparkContext.broadcast((hot[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)))
    found = stage(scored(ids, p, known).withColumn("row", F.monotonically_increasing_id()), "aligned")  # written once: the numbers stay
    known.unpersist()
    links = found.where("size(cold) > 0").select("row", F.explode(F.arrays_zip("cold", "times")).alias("z")).select("row", F.col("z.cold").alias("pair"), F.col("z.times").alias("times"))
    rest = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return found.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
