"""Words of many texts at once: byte positions, 64-bit word hashes and shingle hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE_BYTES = b" \t\n\x0b\x0c\r"  # \x20 and \x09-\x0D
CHUNK_BYTES = 2_000_000  # texts worked on together; a longer text is one chunk

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _ODD)


_BYTE = keys(256, 11)
_POSITION = keys(64, 12) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have


def word_spans(buf: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``is_gap`` (a table of 256); ``buf`` ends with a gap byte."""
    inside = ~is_gap[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes (or of ``values``, one for each place), from one running sum over the buffer."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((_BYTE[buf] if values is None else values) * _power(_BASE, len(buf), "up")[: len(buf)], out=total[1:])
        return mix((total[ends] - total[starts]) * _power(_BASE_INV, len(buf), "down")[starts])


def gap_table(gaps: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(gaps, dtype=np.uint8)] = True
    return out


_SPACE = gap_table(SPACE_BYTES)


class Words:
    """The words of several texts: ``hashes``, byte spans in ``buf`` and, per text, ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, texts: list[bytes], gaps: np.ndarray = _SPACE):
        joined = b"\n".join(texts) + b"\n"
        self.raw = joined
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        self.starts, self.ends = word_spans(self.buf, gaps)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, text_ends))).astype(np.int64)

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; fewer words make one shingle, none make none."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        if n >= k:
            rolled = hashes[: n - k + 1] * _POSITION[0]
            for j in range(1, k):
                rolled = rolled + hashes[j: n - k + 1 + j] * _POSITION[j]
            rolled = mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a: b - k + 1]))
            elif b > a:
                few = (hashes[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([few], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``size`` bytes together."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into slices of about ``size`` bytes of text, each with its texts as bytes."""
    for batch in batches:
        texts = text_bytes(batch.column(text))
        for a, b in chunks(texts, size):
            yield batch.slice(a, b - a), texts[a:b]


def spanning(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the symmetric matrix ``link`` connects, from each vertex to the first of its component."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[at], ids[label[at]]


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Numpy arrays of 64-bit values as one Arrow list<int64> column."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def grouped(batches: Iterable[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal keys, from batches sorted by them; holds one run."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in key:
            new |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            this = tuple(k[a] for k in key)
            if held and this != name:
                yield held
                held = []
            name = this
            held.append(batch.slice(a, b - a))
    if held:
        yield held


class Remembered:
    """Results by word hash: each a short row of numbers; compact, so that millions of words fit a worker.

    Most hashes lie in one sorted array, those added last in a dictionary that is merged into it now and then.
    """

    def __init__(self, kind: type, merge_at: int = 80_000):
        self.merge_at = merge_at
        self.hashes, self.rows = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.fresh: dict[int, int] = {}
        self.flat, self.starts = np.empty(0, dtype=kind), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of distinct hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.rows[at[hit]]
        if self.fresh:
            left = np.flatnonzero(out < 0)
            have = self.fresh.get
            out[left] = [have(h, -1) for h in hashes[left].tolist()]
        return out

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember rows of new hashes; ``flat`` holds them one after the other."""
        rows = np.arange(len(self), len(self) + len(hashes))
        self.fresh.update(zip(hashes.tolist(), rows.tolist()))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))
        if len(self.fresh) > self.merge_at:
            new_h = np.fromiter(self.fresh.keys(), dtype=np.uint64, count=len(self.fresh))
            new_r = np.fromiter(self.fresh.values(), dtype=np.int64, count=len(self.fresh))
            h, r = np.concatenate((self.hashes, new_h)), np.concatenate((self.rows, new_r))
            order = np.argsort(h, kind="stable")
            self.hashes, self.rows, self.fresh = h[order], r[order], {}
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of rows one after the other, and where each row ends (a zero put first)."""
        n = self.starts[rows + 1] - self.starts[rows]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.flat[np.repeat(self.starts[rows] - ends[:-1], n) + np.arange(ends[-1])], ends

    def keep(self, hashes: np.ndarray) -> None:
        """Forget all but the given hashes, as far as they are known."""
        rows = self.find(hashes)
        hashes, rows = hashes[rows >= 0], rows[rows >= 0]
        flat, ends = self.take(rows)
        self.__init__(self.flat.dtype, self.merge_at)
        self.add(hashes, flat, np.diff(ends))
