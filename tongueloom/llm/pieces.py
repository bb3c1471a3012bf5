"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE model of the ``sentencepiece`` format is applied as its agenda: candidate merges wait in a queue by score, then
position; each one taken from the queue is skipped when a keyed hash of the draw and the candidate's place falls below ``dropout``.
With no dropout the pieces are those of the library. Pieces of the model never join a white-space mark onto what
stands before it, so the agenda runs per word. Every occurrence of a word has a draw of its own; what is remembered are segmentations by
word and skipped places of the agenda, so an occurrence only hashes the candidates that it meets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tongueloom.llm.common import prepare
from tongueloom.llm.wordhash import Remembered, keys, mix, slices, span_hashes

MARK = "▁"
_MASK = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # spread the place of a candidate over 64 bits
_SIDE_BY_SIDE = 48  # longer words are segmented one by one


@dataclass(frozen=True)
class PieceCodec:
    """``model``: path of the model file on every worker; ``dropout``: share of candidate merges skipped; ``cache``: segmentations kept.

    ``draws`` None: the key of a draw is made of word, document and place; a number: all words share so many keys.
    """

    model: str
    dropout: float = 0.1
    seed: int = 17
    draws: int | None = None
    cache: int = 1_000_000


class PieceModel:
    """Pieces, scores and byte pieces of a BPE model with byte fallback, escaped white space and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if (train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix):
            raise ValueError("needs a BPE model with byte fallback, a leading mark and no normalisation")
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for i, piece in enumerate(proto.pieces):
            if piece.type == 6:
                value = int(piece.piece[1:-1], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            elif piece.type in (1, 4, 5):
                self.id[piece.piece], self.score[piece.piece] = i, piece.score
                self.surface.append(piece.piece.replace(MARK, " ").encode())
            else:
                self.surface.append(b"")
        if any(MARK in p.lstrip(MARK) for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece of this model joins a mark onto text, or has a character without a piece")
        self.n = len(self.surface)
        self.char = np.full(0x110000, -1, dtype=np.int32)  # piece of a character; -1: spelt in bytes
        self.length = np.zeros(self.n, dtype=np.int64)
        made: dict[int, int] = {}
        for piece, i in self.id.items():
            self.length[i] = len(piece)
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = self.id.get(piece[:k]), self.id.get(piece[k:])
                if left is not None and right is not None:
                    made[left * self.n + right] = i
        self.char[ord(" ")] = self.id[MARK]
        self.char[ord(MARK)] = -1  # a mark that the text itself holds, so that it is not read back as a space
        self.pairs = np.array(sorted(made), dtype=np.int64)
        self.pair_piece = np.array([made[k] for k in self.pairs.tolist()], dtype=np.int32)
        cost = np.zeros(self.n)
        for piece, i in self.id.items():
            cost[i] = -self.score[piece]
        self.pair_cost = cost[self.pair_piece]

    def segment(self, unit: str, key: int, cut: int) -> tuple[int, ...]:
        """Ids of one word. ``key`` names the draw; a candidate whose keyed hash is below ``cut`` (of 2**32) is skipped."""
        score = self.score
        text = list(unit)
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = text[i] + text[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            if not text[a] or not text[b] or after[a] != b or len(text[a]) + len(text[b]) != len(pair):
                continue
            if cut:
                h = (key ^ (a * _A + b * _B + len(pair) * _C)) & _MASK
                h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
                h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) & _MASK
                if h >> 32 < cut:
                    continue
            text[a], text[b] = pair, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                right = pair + text[c]
                if right in score:
                    heapq.heappush(agenda, (-score[right], a, c, right))
            z = before[a]
            if z >= 0:
                left = text[z] + pair
                if left in score:
                    heapq.heappush(agenda, (-score[left], z, a, left))
        out: list[int] = []
        for t in text:
            if t:
                known = self.id.get(t)
                out.extend([known] if known is not None else [self.byte[x] for x in t.encode()])
        return tuple(out)

    def segment_many(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, ...]:
        """``segment`` of many words side by side: ids one after the other, how many each has, and the same of the candidates taken (place, place and length, 8 bits each).

        ``chars`` are ids of single characters. A step takes the best waiting candidate of every word: it is skipped if ``skips`` (a row of
        steps for each word) has the step, or its two symbols are joined and the candidates next to them renewed.
        """
        n, width = len(starts), int((ends - starts).max())
        at = starts[:, None] + np.arange(width)
        alive = at < ends[:, None]
        sym = np.where(alive, chars[np.minimum(at, len(chars) - 1)], -1)
        after = np.where(alive, np.arange(1, width + 1), width)
        after = np.where(after >= (ends - starts)[:, None], width, after)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        sym = np.concatenate((sym, np.full((n, 1), -1, dtype=sym.dtype)), axis=1)  # the column past the last one stands for no symbol
        joined, cost = self._joined(sym[:, :-1], sym[:, 1:])
        live = np.flatnonzero(np.isfinite(cost).any(axis=1))
        owners, taken, step = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], 0
        while len(live):
            p = cost[live].argmin(axis=1)
            some = np.isfinite(cost[live, p])
            live, p = live[some], p[some]
            owners.append(live)
            taken.append((p | after[live, p] << 8 | self.length[joined[live, p]] << 16).astype(np.int32))
            skip = (skips[live] == step).any(axis=1)
            step += 1
            cost[live[skip], p[skip]] = np.inf
            r, p = live[~skip], p[~skip]
            q = after[r, p]
            new, far, near = joined[r, p], after[r, q], before[r, p]
            sym[r, p] = new
            alive[r, q] = False
            cost[r, q] = np.inf
            after[r, p] = far
            has = far < width
            before[r[has], far[has]] = p[has]
            joined[r, p], cost[r, p] = self._joined(new, sym[r, far])
            has = near >= 0
            joined[r[has], near[has]], cost[r[has], near[has]] = self._joined(sym[r[has], near[has]], new[has])
        owner = np.concatenate(owners)
        return sym[:, :-1][alive], alive.sum(axis=1), np.concatenate(taken)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two symbols make and its cost, infinite where they make none."""
        pair = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = (self.pairs[at] == pair) & (right >= 0) & (left >= 0)
        return np.where(hit, self.pair_piece[at], 0), np.where(hit, self.pair_cost[at], np.inf)

    @staticmethod
    def _skipped(key: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, cut: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key ^ (a.astype(np.uint64) * np.uint64(_A) + b.astype(np.uint64) * np.uint64(_B) + size.astype(np.uint64) * np.uint64(_C))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(32)) < np.uint64(cut)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; what is no valid UTF-8 (never the case for encoded texts) becomes replacement characters."""
        return b"".join(map(self.surface.__getitem__, ids))[1:].decode("utf-8", "replace")


class PieceEncoder:
    """Encodes texts; the segmentations of words are remembered by hash of word and skipped steps."""

    def __init__(self, codec: PieceCodec):
        self.model, self.codec = PieceModel(codec.model), codec
        self.cut = int(codec.dropout * (1 << 32))
        self.draw_keys = None if codec.draws is None else keys(codec.draws, codec.seed)
        self.forget()

    def forget(self) -> None:
        self.known = Remembered(np.int32)

    def encode(self, doc_id: int | None, text: str) -> list[int]:
        return self.encode_all([doc_id], [text])[0].tolist()

    def encode_all(self, doc_ids: list[int | None], texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; the draws of a text's words follow from the seed, the document and the word's place."""
        # every text has the leading mark of the model, but an empty one has no pieces
        joined = "".join(" " + t if t else "" for t in texts)
        if not joined:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        edge = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts])))
        chars = self.model.char[code]
        # a word is a run of spaces and what follows it; a character without a piece stands alone
        space, alone = code == 32, chars < 0
        new = np.ones(len(code), dtype=bool)
        new[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        new[edge[:-1][edge[:-1] < len(code)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(code))
        bounds = np.searchsorted(starts, edge)
        with np.errstate(over="ignore"):
            unit = mix(span_hashes(code, starts, ends, mix(code)))
            ids = np.array([-1 if d is None else d for d in doc_ids], dtype=np.int64).view(np.uint64)
            of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            place = (np.arange(len(starts)) - bounds[of]).astype(np.uint64)
            draw = mix(mix(ids ^ keys(1, self.codec.seed))[of] + place)
            draw = mix(draw ^ unit) if self.draw_keys is None else self.draw_keys[(draw % np.uint64(len(self.draw_keys))).astype(np.int64)]
            if self.cut:  # a long word's segmentation is its occurrence's alone
                unit = np.where(ends - starts > _SIDE_BY_SIDE, mix(unit ^ draw), unit)
        if len(self.known) > self.codec.cache:
            self.known.keep(np.unique(unit))
        rows = np.empty(len(starts), dtype=np.int64)
        left, skips = np.arange(len(starts)), np.empty((len(starts), 0), dtype=np.int64)
        while len(left):  # the occurrences with one more skipped step than before
            distinct, first, inverse = np.unique(unit, return_index=True, return_inverse=True)
            at = self.known.find(distinct)
            todo = np.flatnonzero(at < 0)
            if len(todo):
                use = left[first[todo]]
                at[todo] = self.known.add(distinct[todo], *self._segment(code, chars, starts[use], ends[use], draw[use], skips[first[todo]]))
            rows[left] = at[inverse]
            if not self.cut:
                break
            flat, stop = self.known.take(rows[left])
            heads = flat[stop[:-1]]
            size = np.diff(stop) - heads - 1
            edges = np.concatenate(([0], np.cumsum(size)))
            owner = np.repeat(np.arange(len(left)), size)
            step = np.arange(edges[-1]) - edges[owner]
            if skips.shape[1]:  # the steps up to the last skip are settled
                new = step > skips[owner, -1]
                owner, step = owner[new], step[new]
            packed = flat[(stop[:-1] + 1 + heads)[owner] + step]
            hit = self.model._skipped(draw[left[owner]], packed & 255, packed >> 8 & 255, packed >> 16, self.cut)
            again, at = np.unique(owner[hit], return_index=True)
            skips = np.column_stack((skips[again], step[hit][at]))
            left = left[again]
            with np.errstate(over="ignore"):
                unit = mix(unit[again] + skips[:, -1].astype(np.uint64) + np.uint64(1))
        flat, stop = self.known.take(rows)
        heads = flat[stop[:-1]].astype(np.int64)
        ends_ = np.concatenate(([0], np.cumsum(heads)))
        ids = flat[np.repeat(stop[:-1] + 1 - ends_[:-1], heads) + np.arange(ends_[-1])]
        cut = ends_[bounds]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _segment(
        self, code: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, draw: np.ndarray, skips: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows of new segmentations one after the other, and their lengths: the number of ids, the ids, the candidates taken."""
        size = ends - starts
        parts: list = [None] * len(starts)
        limit = 1
        while limit < _SIDE_BY_SIDE:
            low, limit = limit if limit > 1 else 0, min(_SIDE_BY_SIDE, limit * 2)
            fits = np.flatnonzero((size > low) & (size <= limit) & (chars[starts] >= 0))
            for k in range(0, len(fits), 20_000):
                use = fits[k:k + 20_000]
                ids, n, taken, m = self.model.segment_many(chars, starts[use], ends[use], skips[use])
                both = np.empty(len(use) + len(ids) + len(taken), dtype=np.int32)
                stop = np.cumsum(n + m + 1)
                begin = stop - (n + m + 1)
                both[begin] = n
                both[np.repeat(begin + 1 - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
                both[np.repeat(begin + 1 + n - np.cumsum(m) + m, m) + np.arange(len(taken))] = taken
                for i, a, b in zip(use.tolist(), begin.tolist(), stop.tolist()):
                    parts[i] = both[a:b]
        for i in [i for i, x in enumerate(parts) if x is None]:
            word = code[starts[i]: ends[i]].tobytes().decode("utf-32-le")
            if chars[starts[i]] < 0:
                ids = [self.model.byte[x] for x in word.encode()]
            else:
                ids = self.model.segment(word.replace(" ", MARK), int(draw[i]), self.cut)
            parts[i] = np.array([len(ids), *ids], dtype=np.int32)
        return np.concatenate(parts), np.array([len(x) for x in parts])


_encoders: dict[PieceCodec, PieceEncoder] = {}


def encoder(codec: PieceCodec) -> PieceEncoder:
    if codec not in _encoders:
        _encoders.clear()
        _encoders[codec] = PieceEncoder(codec)
    return _encoders[codec]


def _more(df: DataFrame, name: str, kind: str) -> StructType:
    return df.limit(0).withColumn(name, F.lit(None).cast(kind)).schema


def _lists(ids: list[np.ndarray], null: np.ndarray) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges, mask=np.append(null, False)), pa.array(np.concatenate(ids)))


def _encoded(docs: DataFrame, codec: PieceCodec, into: str | None) -> DataFrame:
    """``docs`` with ``ids``, and with their decoded text in ``into`` if that is named."""
    prepare(docs.sparkSession)
    docs = docs.drop("ids", into) if into else docs.drop("ids")
    names = [*docs.columns, "ids", *([into] if into else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(codec)
        try:
            for batch, texts in slices(batches, "text"):
                ids = one.encode_all(batch.column("doc_id").to_pylist(), [t.decode() for t in texts])
                null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
                columns = [*batch.columns, _lists(ids, null)]
                if into:
                    columns.append(pa.array([None if gone else one.model.decode(x.tolist()) for x, gone in zip(ids, null)], type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            one.forget()  # a worker lives on and goes to other operators

    schema = _more(docs, "ids", "array<int>")
    return docs.mapInArrow(run, schema.add(into, "string") if into else schema)


def encode(docs: DataFrame, codec: PieceCodec) -> DataFrame:
    """``docs`` with a column ``ids array<int>``; a column of that name is replaced, all others are kept.

    The same seed, ``doc_id`` and text give the same ids wherever they run, so a repeated row gives the same ids. A null text
    gives null ids, an empty one no ids. A null ``doc_id`` draws like the id -1. Texts are encoded whole.
    """
    return _encoded(docs, codec, None)


def round_trip(docs: DataFrame, codec: PieceCodec, into: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts."""
    return _encoded(docs, codec, into)


def decode(encoded: DataFrame, codec: PieceCodec, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in the column ``into`` (replaced if there); null ids give null, no ids an empty text."""
    encoded = encoded.drop(into)
    names = [*encoded.columns, into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(codec).model
        for batch in batches:
            column = batch.column("ids")
            texts = [None if not ids.is_valid else model.decode(ids.values.to_numpy().tolist()) for ids in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=names)

    return encoded.mapInArrow(run, _more(encoded, into, "string"))
