"""Byte-level BPE encoding and decoding by a tree of joins.

The tokens of a byte string are what merging adjacent parts gives, least rank first and leftmost first. They form a monoid: a
string is cut into halves down to leaves of a few bytes, the leaves are merged directly, and neighbours are joined. Decoding
concatenates up the same kind of tree.

A join re-encodes a window around the border and doubles it on a side until the tokens outside provably stay. The proof: a sequence of tokens
is the encoding of its bytes exactly if each two adjacent tokens, encoded as one string, give back these two. For consider the first merge
across a border of the sequence when the whole string is merged: until then every token has been built from its own parts alone, as it
would be next to its one neighbour, so that merge would also be the next one there. Pairs inside the left part, inside the
right part and inside the window are known to hold, so only the two pairs at the rims of the window are tested.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tongueloom.llm.common import prepare
from tongueloom.llm.wordhash import slices

_EDGE = re.compile(r"^ | $|\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 64  # longer words and strings are not remembered


def units(text: str) -> list[str]:
    """A text cut at the single blanks between two characters that are no white space; these blanks go.

    No match of the usual splitting patterns reaches over such a blank from the left, so ``" " + unit`` (the first unit as it is) can be encoded
    alone.
    """
    return _CUT.split(text) if _EDGE.search(text) else text.split(" ")


class Memory(dict):
    """A dictionary that computes what it does not hold; ``trim`` empties it beyond a number of entries."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _LONG:
            self[key] = value
        return value

    def trim(self, limit: int) -> None:
        if len(self) > limit:
            self.clear()


@dataclass(frozen=True)
class ByteCodec:
    """``ranks``: path of the rank file on every worker; ``pattern`` splits a text into the matches that are encoded apart.

    ``leaf``: bytes merged directly; ``cache``: entries of either memory of a worker, which changes no result.
    """

    ranks: str
    pattern: str
    leaf: int = 8
    cache: int = 300_000


class ByteBPE:
    def __init__(self, codec: ByteCodec):
        with open(codec.ranks, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(n) for token, n in rows}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.surface = [b""] * (max(self.rank.values()) + 1)
        for token, n in self.rank.items():
            self.surface[n] = token
        self.codec, self.pattern = codec, regex.compile(codec.pattern)
        self.forget()

    def forget(self) -> None:
        self.short = Memory(self.merged)  # tokens of short strings: leaves and windows
        self.matches = Memory(self.encode_match)
        self.words = Memory(lambda unit: self.encode_unit(" " + unit))

    def trim(self) -> None:
        for memory in (self.short, self.matches, self.words):
            memory.trim(self.codec.cache)

    def merged(self, raw: bytes) -> list[int]:
        """Tokens of a string by merging, part by part, from an agenda of candidates."""
        n, rank = len(raw), self.rank.get
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the part that starts here ends (0: none starts here)
        agenda = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, end = heappop(agenda)
            middle = stop[i]
            if not middle or middle >= n or stop[middle] != end:
                continue
            stop[i], stop[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(raw[i:stop[end]])) is not None:
                    heappush(agenda, (r, i, stop[end]))
            left = before[i]
            if left >= 0 and (r := rank(raw[left:end])) is not None:
                heappush(agenda, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.rank[raw[i:stop[i]]])
            i = stop[i]
        return out

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens, encoded as one string, give back these two."""
        return self.short[self.surface[left] + self.surface[right]] == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two adjacent strings as one."""
        if not left or not right or self.apart(left[-1], right[0]):
            return left + right
        a = b = 1  # tokens in the window on either side
        while True:
            window = self.short[self.decoded(left[-a:] + right[:b])]
            grow_left = a < len(left) and not self.apart(left[-a - 1], window[0])
            grow_right = b < len(right) and not self.apart(window[-1], right[b])
            if not grow_left and not grow_right:
                return left[:-a] + window + right[b:]
            a = min(2 * a, len(left)) if grow_left else a
            b = min(2 * b, len(right)) if grow_right else b

    def tokens(self, raw: bytes) -> list[int]:
        """The tree: halves are encoded and joined."""
        if len(raw) <= self.codec.leaf:
            return self.short[raw]
        half = len(raw) // 2
        return self.joined(self.tokens(raw[:half]), self.tokens(raw[half:]))

    def encode_match(self, match: str) -> list[int]:
        raw = match.encode("utf-8", "surrogateescape")
        whole = self.rank.get(raw)
        return self.tokens(raw) if whole is None else [whole]

    def encode_unit(self, unit: str) -> bytes:
        return packed([i for match in self.pattern.findall(unit) for i in self.matches[match]])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; borders of matches join by plain concatenation."""
        first, *rest = units(text)
        return self.encode_unit(first) + b"".join(map(self.words.__getitem__, rest))

    def decoded(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.surface.__getitem__, ids))
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(raw: bytes) -> list[int]:
    out = array("I", raw)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


_loaded: dict[ByteCodec, ByteBPE] = {}


def loaded(codec: ByteCodec) -> ByteBPE:
    if codec not in _loaded:
        _loaded.clear()
        _loaded[codec] = ByteBPE(codec)
    return _loaded[codec]


def _with(df: DataFrame, name: str, kind: str) -> StructType:
    return df.limit(0).withColumn(name, F.lit(None).cast(kind)).schema


def encode(docs: DataFrame, codec: ByteCodec, into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in the column ``into``: a binary of little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty binary). Texts are encoded whole, each row by itself, so repeated rows, ties and null ids give
    what their text gives. ``keep`` names the columns to return besides, all by default; a column ``into`` is replaced. Bytes that are no
    UTF-8 are encoded as they stand.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(into)
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(codec)
        try:
            for batch, texts in slices(batches, "text"):
                ids = [bpe.encode(t.decode("utf-8", "surrogateescape")) for t in texts]
                bpe.trim()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, type=pa.binary())], names=[*keep, into])
        finally:
            bpe.forget()  # a worker lives on and goes to other operators

    return docs.mapInArrow(run, _with(docs.select(*keep), into, "binary"))


def decode(encoded: DataFrame, codec: ByteCodec, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the binary column ``into`` (replaced if there); null ids give null, no ids an empty binary.

    An id that the rank file lacks fails the job.
    """
    encoded = encoded.drop(into)
    names = [*encoded.columns, into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(codec)
        for batch in batches:
            texts = [None if x is None else bpe.decoded(unpacked(x)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.binary())], names=names)

    return encoded.mapInArrow(run, _with(encoded, into, "binary"))
