"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once per Python worker; the words of each document are streamed through it, the
length of the longest match ending at each word is tracked, and wherever it reaches a window of an item those words are hit.
Items are taken in blocks of bounded size, one pass over the documents for each, so that neither the
broadcast nor the automaton grows with the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tongueloom.llm.common import attach, row_key, unused
from tongueloom.llm.wordhash import slices
from tongueloom.session import stage


@dataclass(frozen=True)
class Decontam:
    """A hit needs ``window`` consecutive item words (a shorter item: all of its words).

    ``block_bytes`` bounds the item text of one automaton. ``max_coverage``: a document with a larger share of hit words goes
    as a whole in ``remove_hits``; in all others the hit spans go.
    """

    window: int = 10
    block_bytes: int = 1_000_000
    max_coverage: float = 0.8


# every byte that is no digit, letter or part of a non-ASCII character separates words; A-Z count as a-z
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)]) if coded else 0
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.at_window = list(range(len(self.len)))  # the ancestor that holds the suffix of window length
        for s in order:
            if self.len[s] >= window and self.len[self.link[s]] >= window:
                self.at_window[s] = self.at_window[self.link[s]]
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, ids in coded:
            for end, state, length in self.walk(ids):
                if length >= window:
                    self.owners.setdefault(self.at_window[state], set()).add(name)
                elif end == len(ids) - 1 and length == len(ids):
                    self.short.setdefault(state, {}).setdefault(length, set()).add(name)
        self.short_up = [-1] * len(self.len)  # nearest state up the links, itself included, that is a short item
        for s in order:
            self.short_up[s] = s if s in self.short else self.short_up[self.link[s]] if s else -1
        pairs = {a * len(self.vocab) + b for _, ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.len[known] == self.len[last] + 1 else self._clone(last, c, known)
        state = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return state

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """``(position, state, length of the longest match that ends there)`` of a stream of word ids."""
        state = length = 0
        following, link, size = self.next, self.link, self.len
        for i, c in enumerate(ids):
            while state and c not in following[state]:
                state = link[state]
                length = size[state]
            to = following[state].get(c)
            if to is not None:
                state, length = to, length + 1
            yield i, state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Maximal hit ranges ``(first, last)`` of words, the items they are of, and the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        for a, b in self._runs(words):
            ids = [self.vocab[w] for w in words[a:b]]
            for i, state, length in self.walk(ids):
                reach = 0
                if length >= self.window:
                    reach = self.window
                    found |= self.owners[self.at_window[state]]
                s = self.short_up[state]
                while s >= 0:
                    for size, names in self.short[s].items():
                        if size <= length:
                            reach = max(reach, size)
                            found |= names
                    s = self.short_up[self.link[s]] if s else -1
                if reach:
                    longest = max(longest, length)
                    first, last = a + i - reach + 1, a + i
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append((first, last))
        return spans, found, longest

    def _runs(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges of words that could hold a window: known words whose every neighbouring pair is one of an item."""
        if not self.vocab or len(words) < self.shortest:
            return []
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = ids >= 0
        linked = known[1:] & known[:-1]
        at = np.flatnonzero(linked)
        pair = ids[at] * len(self.vocab) + ids[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        linked[at] = self.pairs[place] == pair if len(self.pairs) else False
        edge = np.diff(np.concatenate(([False], linked, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.shortest == 1:
            alone = known & ~np.concatenate(([False], linked)) & ~np.concatenate((linked, [False]))
            return sorted([*zip(first.tolist(), (last + 1).tolist()), *((k, k + 1) for k in np.flatnonzero(alone).tolist())])
        long = last - first + 1 >= self.shortest
        return list(zip(first[long].tolist(), (last[long] + 1).tolist()))


_built: dict[str, ItemAutomaton] = {}


def _automaton(name: str, items: list[tuple[str, bytes]], window: int) -> ItemAutomaton:
    if name not in _built:
        _built.clear()  # one block at a time
        _built[name] = ItemAutomaton([(i, words_of(t)) for i, t in items], window)
    return _built[name]


def _blocks(benchmark: DataFrame, p: Decontam) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks of about ``block_bytes`` by a hash of their text; one block is fetched at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // p.block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [(r.item, r.text.encode()) for r in items.where(block == b).collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam()) -> DataFrame:
    """``(doc_id, n_words, spans, items, longest)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    ``spans`` are maximal ranges of hit words (numbered from 0), ``items`` the distinct ids (as strings, sorted) of the items whose windows
    occur, ``longest`` the longest match that holds a window. A null, empty or wordless text has no words and no hits; null
    or wordless items match nothing; an item without an id is named ``""``; items that share an id count once. Rows that repeat a ``doc_id``
    are each returned with their own hits, whatever the number of blocks: the blocks' hits meet by a 128-bit hash of id and text. Empty tables
    give no rows, or rows without hits.
    """
    return _find_hits(docs, benchmark, p).drop("key")


def _find_hits(docs: DataFrame, benchmark: DataFrame, p: Decontam) -> DataFrame:
    """``find_hits`` with the rows' ``key``."""
    spark = docs.sparkSession
    passes = []
    for number, items in enumerate(_blocks(benchmark, p)):
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch], shared=shared, name=name, number=number) -> Iterator[pa.RecordBatch]:
            auto = _automaton(name, shared.value, p.window)
            for batch, texts in slices(batches, "text"):
                rows = []
                for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), texts):
                    words = words_of(text)
                    spans, found, longest = auto.scan(words)
                    if spans or number == 0:
                        rows.append({"key": key, "doc_id": doc, "n_words": len(words), "spans": [{"first": a, "last": b} for a, b in spans],
                                     "items": sorted(found), "longest": longest})
                yield pa.RecordBatch.from_pylist(rows, schema=_HITS)

        passes.append(docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, _HITS_DDL))
    if len(passes) == 1:
        return passes[0]
    rest = passes[1]
    for more in passes[2:]:
        rest = rest.unionByName(more)
    rest = stage(
        rest.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items"),
                                   F.max("longest").alias("_longest")), "block-hits")
    both = passes[0].join(rest, "key", "left")  # rows of equal id and text have equal hits
    none = F.array()
    return both.select(
        "key", "doc_id", "n_words", _merged(F.concat("spans", F.coalesce("_spans", none.cast(_SPANS_DDL)))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", none.cast("array<string>"))))).alias("items"),
        F.greatest("longest", F.coalesce("_longest", F.lit(0))).cast("int").alias("longest"))


_SPANS_DDL = "array<struct<first:int,last:int>>"
_HITS_DDL = f"key string, doc_id long, n_words long, spans {_SPANS_DDL}, items array<string>, longest int"
_HITS = pa.schema([
    ("key", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ("items", pa.list_(pa.string())), ("longest", pa.int32())])


def _merged(spans: Column) -> Column:
    """Ranges of several blocks as maximal ranges."""

    def add(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"] - 1),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS_DDL), add)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words; what stands between other words is left as it is."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, pos = [], 0
    for a, b in spans:
        out.append(raw[pos:at[a][0]])
        pos = at[b][1]
    return b"".join([*out, raw[pos:]]).decode()


def remove_hits(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam()) -> DataFrame:
    """``docs`` with hit spans cut from ``text``; documents whose share of hit words is over ``max_coverage`` go.

    All columns stay. Hits belong to a row's id and text, so rows that repeat an id, or have none, are cut by their own hits alone; copies of a row
    share them. A null text stays null.
    """
    key, found, over = unused(docs, "row_key"), unused(docs, "hit_spans"), unused(docs, "over_limit")
    hits = _find_hits(docs, benchmark, p).where("size(spans) > 0").dropDuplicates(["key"])
    share = hit_words(F.col("spans")) / F.col("n_words")
    hits = stage(hits.select(F.col("key").alias(key), F.col("spans").alias(found), (share > p.max_coverage).alias(over)), "cuts")
    names = docs.columns
    place = names.index("text")
    rows = attach(docs.withColumn(key, row_key()), hits, [key], "left", F.size(found)).where(F.col(over).isNull() | ~F.col(over)).select(*names, found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.columns[:-1], batch.column(found)
            if spans.null_count < len(spans):
                texts = [t if not s else cut_words(t, [(x["first"], x["last"]) for x in s])
                         for t, s in zip(columns[place].to_pylist(), spans.to_pylist())]
                columns[place] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
