"""Byte-pair vocabulary training and encoding (Sennrich et al. 2016), as grouped counts.

A word type is one string with every symbol between its own two blanks (`` a  b  c ``), so a merge
is a plain ``replace`` that runs left to right without overlap inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tongueloom.config import BOS_ID, EOS_ID, IGNORE_LABEL_ID, MASK_PIECE, PAD_ID, RESERVED_PIECES, UNK_ID, WORD_MARK
from tongueloom.functions.text import words
from tongueloom.operators.merges import MergePlan, next_step, places, train
from tongueloom.session import lookup_join, stage

Pair = tuple[str, str]
KEYS = ("lang", "row_id", "line_no")
VOCAB_LIMIT = 1_000_000


# ---- counts ------------------------------------------------------------------

def word_counts(sentences: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus of all languages."""
    return (
        sentences.select(F.explode(words(F.col("line"))).alias("word"))
        .where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))
    )


def char_counts(counts: DataFrame) -> DataFrame:
    chars = F.explode(F.split(F.concat(F.lit(WORD_MARK), F.col("word")), "")).alias("ch")
    return counts.select(chars, "n").groupBy("ch").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Most frequent characters, added until ``coverage`` of all occurrences is reached: (ch, n, rk).

    The ordered window runs on the character table, which Unicode bounds.
    """
    order = W.orderBy(F.desc("n"), "ch")
    before = F.sum("n").over(order) - F.col("n")
    return (
        char_counts(counts)
        .select("ch", "n", F.row_number().over(order).cast("bigint").alias("rk"), before.alias("_before"),
                F.sum("n").over(W.partitionBy()).alias("_all"))
        .where(F.col("_before") < F.lit(float(coverage)) * F.col("_all"))
        .drop("_before", "_all")
    )


def symbols(word: Column) -> Column:
    """A word as delimited symbols, led by the word mark."""
    chars = F.split(F.concat(F.lit(WORD_MARK), word), "")
    return F.concat(F.lit(" "), F.array_join(chars, "  "), F.lit(" "))


def pieces_of(sym: Column) -> Column:
    return F.split(F.btrim(sym), "  ")


def with_symbols(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sym", symbols(F.col("word")))


def pair_counts(state: DataFrame) -> DataFrame:
    """(left, right, n): adjacent symbols weighted by word frequency."""
    parts = state.select(pieces_of(F.col("sym")).alias("s"), "n").where(F.size("s") > 1)
    m = F.size("s") - 1
    pairs = F.arrays_zip(F.slice("s", F.lit(1), m).alias("left"), F.slice("s", F.lit(2), m).alias("right"))
    return (
        parts.select(F.explode(pairs).alias("q"), "n").select("q.left", "q.right", "n")
        .groupBy("left", "right").agg(F.sum("n").alias("n"))
    )


# ---- training ----------------------------------------------------------------

def train_bpe(
    counts: DataFrame, n_merges: int, allowed: set[str] | None = None, plan: MergePlan = MergePlan(),
) -> tuple[list[Pair], DataFrame]:
    """Exact byte-pair merges, most frequent first (ties: left, then right piece ascending), see ``merges``.

    Returns the merge list and the segmented word types (word, n, pieces). ``allowed`` limits merges to an alphabet.
    """
    words_ = stage(counts.select("word", "n"), "bpe")
    merges = train(words_, n_merges, allowed, plan)
    return merges, encode_words(words_, merges, keep=["n"])


def vocab_table(spark: SparkSession, merges: Sequence[Pair], letters: DataFrame) -> DataFrame:
    """(piece, id): reserved pieces, merges in order, the alphabet by frequency, and the mask at the end."""
    head = [(p, i) for i, p in enumerate(RESERVED_PIECES)]
    made = dict.fromkeys(a + b for a, b in merges)  # two merges can make one piece
    head += [(p, len(head) + i) for i, p in enumerate(made)]
    fixed = spark.createDataFrame(head, "piece string, id bigint")
    own = letters.select(F.col("ch").alias("piece"), (F.lit(len(head) - 1) + F.col("rk")).alias("id"))
    mask = letters.agg((F.count("*") + len(head)).alias("id")).select(F.lit(MASK_PIECE).alias("piece"), "id")
    return fixed.unionByName(own).unionByName(mask)


def vocab_dict(vocab: DataFrame) -> dict[str, int]:
    rows = vocab.limit(VOCAB_LIMIT + 1).collect()
    if len(rows) > VOCAB_LIMIT:
        raise ValueError(f"vocabulary has more than {VOCAB_LIMIT} pieces")
    return {r["piece"]: r["id"] for r in rows}


def learn(sentences: DataFrame, n_merges: int | None = None, coverage: float = 0.9995, vocab_size: int | None = None):
    """Vocabulary of a corpus in one go: (merges, vocab table), with ``n_merges`` merges or up to ``vocab_size`` pieces in all."""
    spark = sentences.sparkSession
    counts = stage(word_counts(sentences), "words")
    letters = stage(alphabet(counts, coverage), "alphabet")
    allowed = {r["ch"] for r in letters.select("ch").collect()}  # at most all of Unicode
    if n_merges is None:
        n_merges = max(0, vocab_size - len(RESERVED_PIECES) - 1 - len(allowed))
    merges, _ = train_bpe(counts, n_merges, allowed)
    return merges, vocab_table(spark, merges, letters)


# ---- encoding ----------------------------------------------------------------

def segmenter(merges: Sequence[Pair]) -> Callable[[str], list[str]]:
    """Word -> pieces by replaying the merges in rank order; one heap, so long words stay cheap."""
    replayed = letters_segmenter(merges)
    return lambda word: replayed(WORD_MARK + word)


def letters_segmenter(merges: Sequence[Pair]) -> Callable[[str], list[str]]:
    """``segmenter`` for letters as they are, without a word mark before them."""
    steps = places(merges)

    def segment(text: str) -> list[str]:
        syms: list[str | None] = [*text]
        size = len(syms)
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(steps[p][0], i, p) for i, p in enumerate(zip(syms, syms[1:])) if p in steps]
        heapify(heap)
        while heap:
            now, i, (a, b) = heappop(heap)
            j = nxt[i]
            if syms[i] != a or j >= size or syms[j] != b:
                continue  # one side was merged away meanwhile
            syms[i], syms[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < size:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < size:
                    pair = (syms[k], syms[nxt[k]])
                    due = next_step(steps, pair, now)
                    if due is not None:
                        heappush(heap, (due, k, pair))
        return [s for s in syms if s is not None]

    return segment


def encode_words(counts: DataFrame, merges: Sequence[Pair], keep: Sequence[str] = ()) -> DataFrame:
    """(word, *keep) -> (word, *keep, pieces): each distinct word once, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces_of = WordPieces(merges)
        for batch in batches:
            n, flat = pieces_of(batch)
            yield _lists(_before(n), flat)

    return counts.select("word", *keep, pieces("word").alias("pieces"))


def _before(sizes: np.ndarray) -> np.ndarray:
    """How much comes before each, and the sum at the end."""
    return np.concatenate([[0], np.cumsum(sizes)])


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(before: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(before, type=pa.int32()), values)


class WordPieces:
    """Pieces of many words at once, or their ids if there is a ``vocab``: how many each word has, and all of them in one array.

    A merge joins two letters at its border, so words are cut wherever two letters stand that no merge joins. Their parts are few; ``most`` of
    them are remembered.
    """

    def __init__(self, merges: Sequence[Pair], vocab: dict[str, int] | None = None, most: int = 200_000):
        self.segment, self.vocab, self.most, self.memory = letters_segmenter(merges), vocab, most, {}
        self.links = np.unique(np.array([ord(a[-1]) << 32 | ord(b[0]) for a, b in merges], dtype=np.int64))
        self.kind = pa.string() if vocab is None else pa.int64()

    def _of(self, part: str) -> list:
        got = self.memory.get(part)
        if got is None:
            got = self.segment(part)
            if self.vocab is not None:
                got = [self.vocab.get(p, UNK_ID) for p in got]
            if len(self.memory) < self.most:
                self.memory[part] = got
        return got

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        coded = words.dictionary_encode()
        marked = [WORD_MARK + w for w in coded.dictionary.to_pylist()]
        text = "".join(marked)
        letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        first = _before(np.array([len(w) for w in marked], dtype=np.int64))
        opens = np.ones(len(letters) + 1, dtype=bool)
        opens[1:-1] = ~np.isin(letters[:-1] << 32 | letters[1:], self.links)
        opens[first] = True
        bounds = np.flatnonzero(opens)
        ends = bounds.tolist()
        own = [self._of(text[i:j]) for i, j in zip(ends, ends[1:])]
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        begin = _before(sizes)[np.searchsorted(bounds, first)]  # of each word in ``flat``
        flat = pa.array(chain.from_iterable(own), type=self.kind)
        code = coded.indices.to_numpy()
        n = np.diff(begin)[code]
        return n, flat.take(pa.array(np.arange(n.sum()) + np.repeat(begin[code] - _before(n)[:-1], n)))


def line_encoder(merges: Sequence[Pair], vocab: dict[str, int]):
    """Column function: sentence -> flat ids. Row by row, so encoding a corpus needs no shuffle."""

    @F.arrow_udf("array<bigint>")
    def encode_line(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = WordPieces(merges, vocab)
        for batch in batches:
            split = [line.split() for line in batch.to_pylist()]
            n, ids = ids_of(pa.array(chain.from_iterable(split), type=pa.string()))
            yield _lists(_before(n)[_before(np.array([len(x) for x in split], dtype=np.int64))], ids)

    return encode_line


def labelled_chunks(merges: Sequence[Pair], vocab: dict[str, int], room: int):
    """Column function: array of words, array of their labels -> chunks ``(ids, tags)`` that hold every id, none of them more than ``room``.

    The first id of a word has its label as tag, the others -100. A word of more than half a chunk is cut into parts of that size. A part goes to
    the chunk of its first id, in steps that leave the room of the sentence's longest part, so no part crosses the end of a chunk. A sentence
    without words has one empty chunk.
    """
    half = room // 2

    def cut(words: pa.Array, labels: pa.Array, ids_of: WordPieces) -> pa.Array:
        n_words, n_labels = _sizes(words), _sizes(labels)
        size, ids = ids_of(words.flatten())
        sentence = np.repeat(np.arange(len(words)), n_words)  # of each word
        begin = _before(size)[_before(n_words)]  # of each sentence in ``ids``
        n_parts = -(-size // half)
        of = np.repeat(np.arange(len(size)), n_parts)  # word of each part
        length = np.minimum(half, size[of] - half * (np.arange(len(of)) - np.repeat(_before(n_parts)[:-1], n_parts)))
        where, start = sentence[of], _before(length)[:-1]
        longest = np.zeros(len(words), dtype=np.int64)
        np.maximum.at(longest, where, length)
        chunk = (start - begin[where]) // (room - longest[where] + 1)
        opens = np.ones(len(of), dtype=bool)
        opens[1:] = (where[1:] != where[:-1]) | (chunk[1:] != chunk[:-1])
        n_chunks = np.bincount(where[opens], minlength=len(words))
        each = np.maximum(n_chunks, 1)
        starts = np.repeat(begin[:-1], each)
        starts[np.repeat(n_chunks > 0, each)] = start[opens]
        bounds = np.append(starts, len(ids))

        place = np.arange(len(size)) - _before(n_words)[sentence]
        own = pa.array(_before(n_labels)[sentence] + place, mask=place >= n_labels[sentence])
        pool = pa.concat_arrays([labels.flatten().take(own), pa.array([IGNORE_LABEL_ID], type=pa.int64())])
        firsts = np.full(len(ids), len(size))
        firsts[_before(size)[:-1]] = np.arange(len(size))
        both = [_lists(bounds, ids), _lists(bounds, pool.take(pa.array(firsts)))]
        return _lists(_before(each), pa.StructArray.from_arrays(both, names=["ids", "tags"]))

    @F.arrow_udf("array<struct<ids:array<bigint>,tags:array<bigint>>>")
    def encode_each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids_of = WordPieces(merges, vocab)
        for words, labels in batches:
            yield cut(words, labels, ids_of)

    return encode_each


def chunks(ids: Column, max_len: int) -> Column:
    """All ids in pieces ``<s>`` ids ``</s>`` of at most ``max_len``; no ids make one piece."""
    room = max_len - 2
    n = F.greatest(F.ceil(F.size(ids) / F.lit(room)), F.lit(1)).cast("int")
    ends = [F.array(F.lit(x).cast("bigint")) for x in (BOS_ID, EOS_ID)]
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(ends[0], F.slice(ids, k * room + 1, F.lit(room)), ends[1]))


def encode_sequences(
    sentences: DataFrame, merges: Sequence[Pair], vocab: dict[str, int], max_len: int = 256, keep: Sequence[str] = KEYS,
) -> DataFrame:
    """(*keep, chunk_no, input_ids): a sentence longer than ``max_len`` goes on in further chunks; no id is lost."""
    raw = sentences.select(*keep, line_encoder(merges, vocab)("line").alias("ids"))
    cut = raw.select(*keep, F.posexplode(chunks(F.col("ids"), max_len)).alias("chunk_no", "input_ids"))
    return cut.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def encode_by_dictionary(
    sentences: DataFrame, merges: Sequence[Pair], vocab: dict[str, int], max_len: int = 256, keep: Sequence[str] = KEYS,
) -> DataFrame:
    """``encode_sequences`` by a join with the dictionary of distinct words, each segmented once.

    Every token is shuffled twice, to its word and back to its line, so this pays only where segmenting costs more than moving. ``keep`` must name
    a line.
    """
    tokens = sentences.select(*keep, F.posexplode(words(F.col("line"))).alias("pos", "word"))
    known = stage(encode_words(tokens.select("word").distinct(), merges), "word-pieces")
    ids = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair]) if len(vocab) <= 1000 else None
    if ids is not None:
        of_piece = F.transform("pieces", lambda p: F.coalesce(F.element_at(ids, p), F.lit(UNK_ID)).cast("bigint"))
        dictionary = known.select("word", F.when(F.col("word") != "", of_piece).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    else:
        pieces = known.where("word <> ''").select("word", F.posexplode("pieces").alias("k", "piece"))
        table = sentences.sparkSession.createDataFrame(list(vocab.items()), "piece string, id bigint")
        row = F.struct("k", F.coalesce("id", F.lit(UNK_ID).cast("bigint")).alias("id"))
        dictionary = lookup_join(pieces, table, ["piece"]).groupBy("word").agg(F.array_sort(F.collect_list(row))["id"].alias("ids"))
    joined = lookup_join(tokens, dictionary, ["word"])
    line = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))))
    lines = joined.groupBy(*keep).agg(F.flatten(line["ids"]).alias("ids"))
    cut = lines.select(*keep, F.posexplode(chunks(F.col("ids"), max_len)).alias("chunk_no", "input_ids"))
    return cut.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def pad_sequences(encoded: DataFrame, mode: str = "longest", max_len: int = 256, keep: Sequence[str] = KEYS) -> DataFrame:
    """Pad on the right to the longest sequence of the language, or to ``max_len``; add the 1/0 mask."""
    size = F.size("input_ids")
    if mode == "longest":
        encoded = stage(encoded, "encoded")  # read twice; encoding again costs more than a write
        longest = encoded.groupBy("lang").agg(F.max(size).alias("_to"))
        wide = lookup_join(encoded, longest, ["lang"], "inner")
    elif mode == "max_length":
        wide = encoded.withColumn("_to", F.lit(max_len))
    else:
        raise ValueError(f"unknown padding mode {mode!r}")
    gap = F.col("_to") - size
    return wide.select(
        *keep, "chunk_no",
        F.concat("input_ids", F.array_repeat(F.lit(PAD_ID).cast("bigint"), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )
