"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel of two words is the inner product of their gap-weighted subsequences of three characters: a subsequence
that spans more characters counts less, so a word with inserted or replaced characters, a new ending or letters set apart still
resembles its pattern. Words of labelled texts are the training units; a handful of them are landmarks, the features of a word are
its kernel values with those, whitened, and a linear SVM separates words of toxic texts from words of clean ones.
A text is scored by the margins of its words, calibrated on labelled texts.

With explicit subsequences the whole model folds into one table of weights, so scoring a word costs a fixed number of lookups a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tongueloom.llm.common import crc_bucket, prepare
from tongueloom.llm.wordhash import Words, slices
from tongueloom.session import stage

BLOCK = 4096  # words of the fit at a time
CODES = 64  # character classes; 0 is a mere gap, the last one stands before every word


@dataclass(frozen=True)
class Toxicity:
    """``docs_per_class`` and ``units`` bound the sample that the classifier is fitted on; scoring covers all texts."""

    span: int = 7
    decay: float = 0.7
    landmarks: int = 64  # of either class
    docs_per_class: int = 4000
    units: int = 40_000
    cost_clean: float = 4.0
    ridge: float = 1e-3
    threshold: float = 0.3
    cache: int = 400_000


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.int32)
    table[128:] = 37 + np.arange(128, 0x110000) % (CODES - 1 - 37)
    table[0x2000:0x2070] = 0  # general punctuation, zero-width marks
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    for k in range(10):
        table[ord("0") + k] = 27 + k
    return table


_TABLE = _code_table()
_APART = re.compile(rb"(?<![^ \t])(?:[^\s][ \t]){2,}[^\s](?![^\s])")


def joined(text: bytes) -> bytes:
    """The text in lower case, runs of three or more single characters set apart made one word."""
    return _APART.sub(lambda m: m.group().replace(b" ", b"").replace(b"\t", b""), text.lower())


class Subsequences:
    """All gap-weighted three-character subsequences of some words: flat places, weights and owners."""

    def __init__(self, words: list[bytes], p: Toxicity):
        joined = "".join("\n" + w.decode("utf-8", "replace") for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = _TABLE[np.minimum(points, 0x10FFFF)]
        codes[points == 10] = CODES - 1  # the mark before a word; words hold no line break
        owner = np.cumsum(points == 10) - 1
        self.n = len(words)
        place, weight, of = [], [], []
        for b in range(2, p.span):
            if len(codes) <= b:
                break
            whole = (owner[b:] == owner[:-b]) & (codes[b:] > 0) & (codes[:-b] > 0)
            at = np.flatnonzero(whole)
            for a in range(1, b):
                use = at[codes[at + a] > 0]
                place.append((codes[use] * CODES + codes[use + a]) * CODES + codes[use + b])
                weight.append(np.full(len(use), p.decay ** (b - 2), dtype=np.float32))
                of.append(owner[use])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, dtype=kind)
        self.place, self.weight, self.of = join(place, np.int32), join(weight, np.float32), join(of, np.int32)
        self.norm = np.sqrt(np.bincount(self.of, self.weight.astype(np.float64) ** 2, self.n))
        self.norm[self.norm == 0] = 1

    def against(self, table: np.ndarray) -> np.ndarray:
        """Inner products with a table over all subsequences."""
        return np.bincount(self.of, self.weight * table[self.place], self.n) / self.norm

    def table(self, coefficients: np.ndarray) -> np.ndarray:
        """The sum of the words' feature vectors times coefficients."""
        return np.bincount(self.place, self.weight * (coefficients / self.norm)[self.of], CODES ** 3)


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray  # over all subsequences
    bias: float
    calibration: tuple[float, float, float]  # constant, greatest margin, log of the sum of margins
    params: Toxicity

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.calibration[0] + self.calibration[1] * features[:, 0] + self.calibration[2] * features[:, 1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Margins of words, each distinct one computed once while it is remembered."""

    def __init__(self, weights: np.ndarray, bias: float, p: Toxicity):
        self.weights, self.bias, self.p = weights, bias, p
        self.known: dict[int, float] = {}  # by the word's hash

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text the greatest positive margin and the log of one plus the sum of positive margins."""
        if len(self.known) > self.p.cache:
            self.known = {}
        words = Words([joined(t) for t in texts])
        out = np.zeros((len(texts), 2))
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if not len(distinct):
            return out
        have = self.known.get
        margin = np.array([have(h, np.nan) for h in distinct.tolist()])
        new = np.flatnonzero(np.isnan(margin))
        for part in np.array_split(new, len(new) // 50_000 + 1) if len(new) else ():
            spans = zip(words.starts[first[part]].tolist(), words.ends[first[part]].tolist())
            margin[part] = np.maximum(Subsequences([words.raw[a:b] for a, b in spans], self.p).against(self.weights) + self.bias, 0)
        self.known.update(zip(distinct[new].tolist(), margin[new].tolist()))
        each = margin[inverse]
        full = np.flatnonzero(np.diff(words.bounds))
        out[full, 0] = np.maximum.reduceat(each, words.bounds[full])
        out[full, 1] = np.log1p(np.add.reduceat(each, words.bounds[full]))
        return out


def _svm(z: np.ndarray, bad: np.ndarray, good: np.ndarray, ridge: float) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the active examples; the last feature is the constant.

    Every row is an example of either class, with the weights ``bad`` and ``good``. Sums go by blocks of rows: the driver holds ``z`` once.
    """
    w = np.zeros(z.shape[1])
    penal = ridge * np.eye(z.shape[1])
    penal[-1, -1] = 1e-9
    for _ in range(50):
        margin = z @ w
        toxic, clean = bad * (margin < 1), good * (margin > -1)
        left = penal.copy()
        for a in range(0, len(z), BLOCK):
            part = z[a:a + BLOCK]
            left += (part * (toxic + clean)[a:a + BLOCK, None]).T @ part
        new = np.linalg.solve(left, (toxic - clean) @ z)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1]),
                               x.T @ (weight * (y - q)) - 1e-4 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Toxicity) -> DataFrame:
    """Up to ``docs_per_class`` labelled texts of either class, outside the held-out ids, with the share drawn."""
    rows = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 4) != 2))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    rows = stage(rows, "labels")
    count = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.docs_per_class)
             .withColumn("weight", F.lit(max(1.0, n / p.docs_per_class))) for c, n in sorted(count.items())]
    if not drawn:
        return docs.limit(0).select("doc_id", "text", F.lit(0).alias("toxic"), F.lit(1.0).alias("weight"))
    picked = drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])
    picked = stage(picked, "drawn")  # at most two times docs_per_class narrow rows
    return stage(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "labelled")


def _word_counts(sample: DataFrame, p: Toxicity) -> list:
    """Words of the sample with the numbers of toxic and clean texts that hold them; the most telling ``units`` of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            words, label = [], []
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                own = {w[:200].decode("utf-8", "ignore") for w in joined(text).split()}  # training units only; scoring takes whole words
                words += own
                label += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(label, type=pa.int32())], names=["word", "toxic"])

    counts = sample.mapInArrow(run, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    return counts.orderBy(F.desc(F.col("toxic") + F.col("clean")), F.xxhash64("word"), "word").limit(p.units).collect()


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> ToxicModel:
    """Learn from labelled texts whose ``crc32(doc_id) mod 4`` is not 2.

    Only texts and labels are used. Without labels of both classes the model is constant: the share of toxic labels (0.0 without any).
    """
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, p)
    sizes = {r.toxic: (r.n, r.w) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if len(sizes) < 2:
        return ToxicModel(np.zeros(CODES ** 3, dtype=np.float32), 0.0, (40.0 if 1 in sizes else -40.0, 0.0, 0.0), p)
    rows = _word_counts(sample, p)
    words = [r.word.encode() for r in rows]
    bad = np.array([r.toxic for r in rows]) / sizes[1][0]
    good = np.array([r.clean for r in rows]) / sizes[0][0]
    blocks = range(0, len(words), BLOCK)
    subs = [Subsequences(words[a:a + BLOCK], p) for a in blocks]
    telling = np.log((bad + 1e-3) / (good + 1e-3)) * np.sqrt(bad)
    chosen = _landmarks(words, np.argsort(-telling, kind="stable"), p) + _landmarks(words, np.argsort(-good, kind="stable"), p)
    chosen = list(dict.fromkeys(chosen))
    marks = Subsequences([words[k] for k in chosen], p)
    z, inner = np.ones((len(words), len(chosen) + 1)), np.empty((len(chosen), len(chosen)))  # kernel values, whitened in place, and the constant
    for k, unit in enumerate(np.eye(len(chosen))):
        table = marks.table(unit)
        for a, own in zip(blocks, subs):
            z[a:a + BLOCK, k] = own.against(table)
        inner[:, k] = marks.against(table)
    del subs
    value, vector = np.linalg.eigh((inner + inner.T) / 2 + 1e-6 * np.eye(len(chosen)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    for a in blocks:
        z[a:a + BLOCK, :-1] = z[a:a + BLOCK, :-1] @ whiten
    w = _svm(z, bad, p.cost_clean * good, p.ridge)
    weights = marks.table(whiten @ w[:-1]).astype(np.float32)
    bias = float(w[-1])
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # CODES ** 3 numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias, p)
        for batch, texts in slices(batches, "text"):
            x = scorer.features(texts)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                             names=["toxic", "weight", "top", "total"])

    seen = sample.mapInArrow(run, "toxic int, weight double, top double, total double").collect()  # a row per drawn text
    x = np.array([(r.top, r.total) for r in seen])
    c = _logistic(x, np.array([r.toxic for r in seen], dtype=float), np.array([r.weight for r in seen]))
    return ToxicModel(weights, bias, (float(c[0]), float(c[1]), float(c[2])), p)


def _landmarks(words: list[bytes], order: np.ndarray, p: Toxicity) -> list[int]:
    """The first words of an order that are not near copies of those taken."""
    taken: list[int] = []
    tables: list[np.ndarray] = []
    for k in order[: 20 * p.landmarks].tolist():
        one = Subsequences([words[k]], p)
        if len(one.place) and all(one.against(t)[0] < 0.9 for t in tables):
            taken.append(k)
            tables.append(one.table(np.ones(1)).astype(np.float32))
        if len(taken) == p.landmarks:
            break
    return taken


_scorers: dict[int, tuple[object, Scorer]] = {}


def _scorer(shared, token: int) -> tuple[ToxicModel, Scorer]:
    model = shared.value
    held = _scorers.get(token)
    if held is None or held[0] is not model:
        _scorers.clear()
        held = _scorers[token] = (model, Scorer(model.weights, model.bias, model.params))
    return held


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``; other columns are ignored.

    A null, empty or blank text has no words and gets the score of a text without telling words. Rows that
    repeat a ``doc_id`` are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = id(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = _scorer(shared, token)
        for batch, texts in slices(batches, "text"):
            s = model.score(scorer.features(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= model.params.threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])
        scorer.known = {}

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` that the model does not predict as toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = id(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = _scorer(shared, token)
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array(model.score(scorer.features(texts)) < model.params.threshold))
        scorer.known = {}  # a worker lives on and goes to other operators

    return docs.mapInArrow(run, docs.schema)
