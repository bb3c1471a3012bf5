"""Token tagging: CoNLL sentences, sub-word features, a lexicon tagger, spans, metrics and export."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tongueloom.config import BOS_ID, EOS_ID, IGNORE_LABEL_ID, NER_TAGS, PAD_ID
from tongueloom.functions.arrays import argmax_index, label_indices
from tongueloom.functions.text import strip
from tongueloom.operators.classify import ratio
from tongueloom.operators.rank import running_sum
from tongueloom.operators.subword import labelled_chunks
from tongueloom.session import lookup_join, stage
from tongueloom.sources.readers import parse_conll, token_fields

LINES_PER_BUCKET = 1 << 20
DOC_MARK = "-DOCSTART-"


# ---- reading -----------------------------------------------------------------

def mark_sentences(lines: DataFrame, lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """Add ``gap``: how many break lines of the file come up to and including this line.

    Lines that carry it already are returned as they are.
    """
    if "gap" in lines.columns:
        return lines
    is_break = (F.length(strip(F.col("line"))) < 2).cast("int")
    bucket = F.floor(F.col("line_no") / F.lit(lines_per_bucket))
    return running_sum(lines, ["file"], bucket, ["line_no"], "gap", is_break)


def _runs_of(ends: np.ndarray, data) -> pa.Array:
    """Binary values that lie one after the other in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(file, bucket, no, word, tag)`` as a row per batch, file and bucket: steps of the numbers, joined texts and their sizes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code, bucket = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("bucket").to_numpy()
        order = np.lexsort((bucket, code))
        if (order[1:] < order[:-1]).any():
            batch, code, bucket = batch.take(pa.array(order)), code[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]))))
        ends = np.append(cuts, n)
        no = batch.column("no").to_numpy()
        steps = np.diff(no, prepend=0)
        steps[cuts] = no[cuts]
        columns = [batch.column("file").take(pa.array(cuts)), pa.array(bucket[cuts]), _runs_of(8 * ends, steps.tobytes())]
        for name in ("word", "tag"):
            texts = batch.column(name).cast(pa.string())
            at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset: texts.offset + n + 1]
            joined = memoryview(texts.buffers()[2] or b"")[int(at[0]): int(at[-1])]
            columns += [_runs_of(at[ends] - at[0], joined), _runs_of(4 * ends, np.diff(at).tobytes())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "bucket", "no", "word", "word_size", "tag", "tag_size"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_packed`` makes, sorted by file and bucket, as the sentences in each bucket: ``piece`` counts those with a token, ``gap`` the breaks before.

    A row of its own, with ``piece`` -1, has all breaks of the bucket. Lines of one number are ordered by their text, a break first.
    """

    def strings(sizes: np.ndarray, data: bytes) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def cut(key: tuple[str, int], rows: list[dict]) -> pa.RecordBatch:
        no = np.concatenate([np.cumsum(np.frombuffer(r["no"], dtype=np.int64)) for r in rows])
        sizes, tag_sizes = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int32) for c in ("word_size", "tag_size"))
        words, tags = (strings(s, b"".join(r[c] for r in rows)) for s, c in ((sizes, "word"), (tag_sizes, "tag")))
        if (no[1:] <= no[:-1]).any():
            order = np.argsort(no, kind="stable")
            if (np.diff(no[order]) == 0).any():
                w, t = words.to_pylist(), tags.to_pylist()
                order = np.array(sorted(range(len(no)), key=lambda i: (no[i], w[i], t[i])))
            words, tags, sizes = words.take(pa.array(order)), tags.take(pa.array(order)), sizes[order]
        token = sizes > 0
        gap = np.cumsum(~token)
        own, mask = gap[token], pa.array(token)
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, dtype=np.int64)
        m = len(starts)
        ends, no_list = pa.array([*starts.tolist(), len(own), len(own)], type=pa.int32()), pa.array([False] * m + [True])
        lists = [pa.ListArray.from_arrays(ends, x.filter(mask), mask=no_list) for x in (words, tags)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * (m + 1), type=pa.string()), pa.array([key[1]] * (m + 1), type=pa.int64()), pa.array([*range(m), -1], type=pa.int64()),
             pa.array([*own[starts].tolist(), int(gap[-1])], type=pa.int64()), *lists], names=["file", "bucket", "piece", "gap", "words", "labels"])

    key, held = None, []
    for batch in batches:
        for row in ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for i in range(batch.num_rows)):
            if (now := (row["file"], row["bucket"])) != key and held:
                yield cut(key, held)
                held = []
            key = now
            held.append(row)
    if held:
        yield cut(key, held)


def conll_sentences(lines: DataFrame, mode: str = "test", lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """(file,line_no,line) -> (file,guid,words,labels); runs of breaks make no empty sentences.

    Lines are read once and moved once, packed into a row per batch and bucket of ``lines_per_bucket`` numbers. A bucket is cut into sentences on its
    own; only what is open at its ends is joined with its neighbours, as a table of buckets tells. Lines that carry ``gap`` already are grouped by it.
    """
    if "gap" in lines.columns:
        return _sentences_by_gap(lines, mode, lines_per_bucket)
    text, word, tag = token_fields(F.col("line"))
    token, number = F.length(text) >= 2, F.col("line_no").cast("bigint")
    rows = lines.where(F.col("file").isNotNull() & number.isNotNull() & F.col("line").isNotNull()).select(
        F.col("file").cast("string").alias("file"), F.floor(number / F.lit(lines_per_bucket)).alias("bucket"), number.alias("no"),
        *[F.when(token, x).otherwise(F.lit("")).alias(c) for c, x in (("word", word), ("tag", tag))])
    packed = rows.mapInArrow(_packed, "file string, bucket long, no binary, word binary, word_size binary, tag binary, tag_size binary")
    dealt = packed.repartition("file", "bucket").sortWithinPartitions("file", "bucket")
    pieces = stage(dealt.mapInArrow(_pieces, "file string, bucket long, piece long, gap long, words array<string>, labels array<string>"), "sentences")
    of_piece = F.when(F.col("piece") >= 0, F.col("gap"))
    in_file = W.partitionBy("file").orderBy("bucket")  # a row per bucket
    upto, after = in_file.rowsBetween(W.unboundedPreceding, -1), in_file.rowsBetween(1, W.unboundedFollowing)
    cells = (
        pieces.groupBy("file", "bucket").agg(F.max(F.when(F.col("piece") < 0, F.col("gap"))).alias("breaks"), F.count(of_piece).alias("n"),
                                             F.min(of_piece).alias("first"), F.max(of_piece).alias("last"))
        .withColumn("before", F.coalesce(F.sum("breaks").over(upto), F.lit(0)))
        .withColumn("goes_on", F.coalesce((F.col("first") == 0) & (F.max(F.col("before") + F.col("last")).over(upto) == F.col("before")), F.lit(False)))
        .withColumn("open_end", F.coalesce(  # the next bucket that goes on with a sentence goes on with this one's last
            F.min(F.when(F.col("goes_on"), F.col("before"))).over(after) == F.col("before") + F.col("breaks"), F.lit(False)))
        .withColumn("told", F.coalesce(F.sum(F.col("n") - F.col("goes_on").cast("int")).over(upto), F.lit(0)) + 1 - F.col("goes_on").cast("int"))
        .select("file", "bucket", "breaks", "goes_on", "open_end", "told")
    )
    numbered = lookup_join(pieces.where(F.col("piece") >= 0), stage(cells, "buckets"), ["file", "bucket"], "inner", staged=True)
    is_open = (F.col("goes_on") & (F.col("gap") == 0)) | (F.col("open_end") & (F.col("gap") == F.col("breaks")))
    numbered = numbered.select("file", "bucket", (F.col("told") + F.col("piece")).alias("k"), "words", "labels", is_open.alias("open"))
    parts = numbered.where("open").groupBy("file", "k").agg(F.array_sort(F.collect_list(F.struct("bucket", "words", "labels"))).alias("t"))
    whole = numbered.where("not open").select("file", "k", "words", "labels").unionByName(
        parts.select("file", "k", F.flatten("t.words").alias("words"), F.flatten("t.labels").alias("labels")))
    return whole.select("file", F.concat_ws("-", F.lit(mode), "k").alias("guid"), "words", "labels")


def _sentences_by_gap(marked: DataFrame, mode: str, lines_per_bucket: int) -> DataFrame:
    tokens = parse_conll(marked.withColumn("file", F.struct("file", "gap")))
    row = F.struct("line_no", "word", "tag")
    grouped = stage(tokens.groupBy("file.file", "file.gap").agg(F.array_sort(F.collect_list(row)).alias("t")), "sentences")
    first = F.floor(F.col("t")[0]["line_no"] / F.lit(lines_per_bucket))
    numbered = running_sum(grouped, ["file"], first, ["gap"], "k")
    return numbered.select(
        "file", F.concat_ws("-", F.lit(mode), "k").alias("guid"), F.col("t.word").alias("words"), F.col("t.tag").alias("labels")
    )


# ---- features ----------------------------------------------------------------

def align_labels(
    sentences: DataFrame, merges, vocab: dict[str, int], labels: Sequence[str] = tuple(NER_TAGS), max_len: int = 164,
    cls_at_end: bool = False, sep_extra: bool = False, pad_left: bool = False, cls_segment: int = 0,
    pad_segment: int = 0, keep: Sequence[str] = ("guid",),
) -> DataFrame:
    """First piece of a word carries the tag id, its other pieces -100; cut into chunks between words, framed and padded.

    ``chunk_no`` and four arrays of exactly ``max_len``: input_ids, input_mask, segment_ids, label_ids. A word without
    pieces becomes ``<unk>``. No id and no label is lost: a sentence takes as many chunks as it needs.
    """
    big = lambda v: F.lit(v).cast("bigint")
    room = max_len - (3 if sep_extra else 2)
    tags_of = label_indices(F.col("labels"), labels, "tag")
    cut = sentences.select(*keep, F.posexplode(labelled_chunks(merges, vocab, room)("words", tags_of)).alias("chunk_no", "_c"))
    body = cut.select(*keep, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("_c.ids").alias("_ids"), F.col("_c.tags").alias("_tags"))
    seps = 2 if sep_extra else 1
    eos, cls, ign = [big(EOS_ID)] * seps, [big(BOS_ID)], [big(IGNORE_LABEL_ID)]
    zeros = F.array_repeat(big(0), F.size("_ids") + seps)
    if cls_at_end:
        ids = F.concat("_ids", F.array(*eos, *cls))
        tags = F.concat("_tags", F.array(*ign * (seps + 1)))
        segments = F.concat(zeros, F.array(big(cls_segment)))
    else:
        ids = F.concat(F.array(*cls), "_ids", F.array(*eos))
        tags = F.concat(F.array(*ign), "_tags", F.array(*ign * seps))
        segments = F.concat(F.array(big(cls_segment)), zeros)

    def padded(values: Column, fill: int) -> Column:
        pad = F.array_repeat(big(fill), F.lit(max_len) - F.size(values))
        return F.concat(pad, values) if pad_left else F.concat(values, pad)

    mask = F.array_repeat(big(1), F.size(ids))
    return body.select(
        *keep, "chunk_no", padded(ids, PAD_ID).alias("input_ids"), padded(mask, 0).alias("input_mask"),
        padded(segments, pad_segment).alias("segment_ids"), padded(tags, IGNORE_LABEL_ID).alias("label_ids"),
    )


# ---- tagging -----------------------------------------------------------------

def fit_lexicon(tokens: DataFrame) -> DataFrame:
    """Most frequent tag of each (lang, word); ties to the smaller tag."""
    counted = tokens.groupBy("lang", "word", "tag").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("tag").alias("tag")))
    return counted.groupBy("lang", "word").agg(best.alias("b")).select("lang", "word", F.col("b.tag").alias("pred"))


def tag(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Look every token up; unknown words are ``O``."""
    return lookup_join(tokens, lexicon, ["lang", "word"]).withColumn("pred", F.coalesce("pred", F.lit("O")))


def decode_tags(label_ids: Column, values: Column, labels: Sequence[str] = tuple(NER_TAGS)) -> Column:
    """``values`` (ids) at the positions whose ``label_ids`` is not -100, as tags."""
    names = F.array(*[F.lit(x) for x in labels])
    kept = F.filter(F.arrays_zip(label_ids.alias("y"), values.alias("v")), lambda z: z["y"] != IGNORE_LABEL_ID)
    return F.transform(kept, lambda z: F.element_at(names, (z["v"] + 1).cast("int")))


def fit_piece_scores(features: DataFrame, n_pieces: int, n_labels: int) -> np.ndarray:
    """How often each piece, as the first one of a word, carries each label: a table of vocabulary size, the model of a simple tagger."""
    table = np.zeros((n_pieces, n_labels))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_pieces * n_labels, dtype=np.int64)
        for batch in batches:
            ids, labels = (batch.column(c).flatten().to_numpy() for c in ("input_ids", "label_ids"))
            kept = labels != IGNORE_LABEL_ID
            ids, labels = ids[kept], labels[kept]
            if len(ids) and not (0 <= ids.min() and ids.max() < n_pieces and 0 <= labels.min() and labels.max() < n_labels):
                raise IndexError(f"an id or a label is outside the table of {n_pieces} pieces and {n_labels} labels")
            seen += np.bincount(ids * n_labels + labels, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at // n_labels), pa.array(at % n_labels), pa.array(seen[at])], names=["piece", "label", "n"])

    each = features.select("input_ids", "label_ids").mapInArrow(count, "piece long, label long, n long")
    for r in each.groupBy("piece", "label").agg(F.sum("n").alias("n")).collect():  # at most one row per piece and label
        table[r.piece, r.label] = r.n
    return table


def predict_scores(features: DataFrame, predictor: Callable[[np.ndarray, np.ndarray], np.ndarray], n_labels: int, rows: int = 256) -> DataFrame:
    """Add ``scores``: for every position of a row a score per label.

    ``predictor`` takes ``input_ids`` and ``input_mask`` of up to ``rows`` rows as matrices and returns an array (rows, positions, labels); all
    rows of ``features`` must be padded to one length. A predictor that fails, or returns another shape, ends the job.
    """
    schema = features.withColumn("scores", F.array().cast("array<array<double>>")).schema
    names = features.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                n = batch.num_rows
                ids, mask = (batch.column(c).flatten().to_numpy().reshape(n, -1) for c in ("input_ids", "input_mask"))
                scores = np.asarray(predictor(ids, mask), dtype=np.float64)
                if scores.shape != (*ids.shape, n_labels):
                    raise ValueError(f"the predictor returned {scores.shape}, not {(*ids.shape, n_labels)}")
                each = pa.ListArray.from_arrays(pa.array(np.arange(ids.size + 1, dtype=np.int32) * n_labels), pa.array(scores.ravel()))
                by_row = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * ids.shape[1]), each)
                yield pa.RecordBatch.from_arrays([*batch.columns, by_row], names=[*names, "scores"])

    return features.mapInArrow(run, schema)


def decoded(scored: DataFrame, labels: Sequence[str] = tuple(NER_TAGS), keep: Sequence[str] = ("guid",)) -> DataFrame:
    """``(keep, labels, pred)``: gold and predicted tags of whole sentences, from the chunks' ``label_ids`` and ``scores``.

    The best score of a position is its label, the first one on ties; positions whose ``label_ids`` is -100 are left out; chunks are joined in order.
    """
    names = F.array(*[F.lit(x) for x in labels])
    tag_at = lambda i: F.element_at(names, (i + 1).cast("int"))
    # positions are dropped before their scores are looked at: most of a padded row has no label
    kept = F.filter(F.arrays_zip(F.col("label_ids").alias("y"), F.col("scores").alias("s")), lambda z: z["y"] != IGNORE_LABEL_ID)
    both = F.transform(kept, lambda z: F.struct(tag_at(z["y"]).alias("y"), tag_at(argmax_index(z["s"])).alias("p")))
    parts = scored.select(*keep, F.struct("chunk_no", both.alias("b")).alias("part"))
    each = parts.groupBy(*keep).agg(F.array_sort(F.collect_list("part")).alias("c")).select(*keep, F.flatten("c.b").alias("b"))
    return each.select(*keep, F.col("b.y").alias("labels"), F.col("b.p").alias("pred"))


def spans(tags: Column) -> Column:
    """Tag array -> array of (type, start, end), 0-based and inclusive.

    A span starts at ``B-x``, or at ``I-x`` after ``O``, nothing or another type, and ends before the
    next start or ``O``. Starts and ends pair up in order, so no shuffle and no window is needed.
    """
    none = F.array(F.lit(None).cast("string"))
    kind = lambda t: F.substring(t, 3, 2**31 - 1)
    before = F.slice(F.concat(none, tags), F.lit(1), F.size(tags))
    after = F.slice(F.concat(tags, none), F.lit(2), F.size(tags))

    def opens(t: Column, b: Column) -> Column:
        return (t != "O") & (b.isNull() | t.startswith("B-") | (b == "O") | (kind(b) != kind(t)))

    def closes(t: Column, a: Column) -> Column:
        return (t != "O") & (a.isNull() | (a == "O") | opens(a, t))

    def places(flags: Column) -> Column:
        return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())

    return F.zip_with(
        places(F.zip_with(tags, before, opens)), places(F.zip_with(tags, after, closes)),
        lambda s, e: F.struct(kind(F.get(tags, s)).alias("type"), s.alias("start"), e.alias("end")),
    )


def bio_spans(sentences: DataFrame, col: str = "labels", keep: Sequence[str] = ("guid",)) -> DataFrame:
    """One row per entity span."""
    return sentences.select(*keep, F.explode(spans(F.col(col))).alias("s")).select(*keep, "s.type", "s.start", "s.end")


def ner_report(sentences: DataFrame, gold: str = "labels", pred: str = "pred") -> DataFrame:
    """(type, precision, recall, f1, support) per entity type plus ``micro avg``, ``macro avg`` and
    ``weighted avg``. Gold and predicted tags of a sentence sit in one row, so matching spans is an
    array intersection and only counts per type are shuffled."""
    both = sentences.select(spans(F.col(gold)).alias("g"), spans(F.col(pred)).alias("p"))
    both = both.withColumn("hit", F.array_intersect("g", "p"))
    mark = lambda c, a, b, t: F.transform(c, lambda s: F.struct(
        s["type"].alias("type"), F.lit(a).alias("g"), F.lit(b).alias("p"), F.lit(t).alias("t")))
    rows = both.select(F.explode(F.concat(mark("g", 1, 0, 0), mark("p", 0, 1, 0), mark("hit", 0, 0, 1))).alias("r"))
    by_type = rows.groupBy("r.type").agg(*[F.sum(f"r.{c}").alias(c) for c in ("g", "p", "t")])
    g, p, t = F.col("g"), F.col("p"), F.col("t")
    scored = by_type.select("type", "g", "p", "t", ratio(t, p).alias("precision"), ratio(t, g).alias("recall"),
                            ratio(F.lit(2.0) * t, g + p).alias("f1"))
    measures = ("precision", "recall", "f1")
    # one row per entity type from here on
    overall = scored.agg(*[F.sum(c).alias(c) for c in ("g", "p", "t")],
                         *[F.avg(m).alias(f"a_{m}") for m in measures],
                         *[(F.sum(F.col(m) * g) / F.sum(g)).alias(f"w_{m}") for m in measures])
    line = lambda name, a, b, c: F.struct(
        F.lit(name).alias("type"), a.alias("precision"), b.alias("recall"), c.alias("f1"), g.alias("support"))
    averages = overall.select(F.explode(F.array(
        line("micro avg", ratio(t, p), ratio(t, g), ratio(F.lit(2.0) * t, g + p)),
        line("macro avg", *[F.col(f"a_{m}") for m in measures]),
        line("weighted avg", *[F.col(f"w_{m}") for m in measures]),
    )).alias("l")).select("l.*")
    return scored.select("type", *measures, g.alias("support")).unionByName(averages)


# ---- export ------------------------------------------------------------------

def export(lines: DataFrame, predicted: DataFrame) -> DataFrame:
    """Line predictions up with the input lines: (file, line_no, out_line, status).

    ``predicted`` is (file, line_no, pred), the line a token was read from. Breaks and document marks pass through; a token
    without a prediction has a null line and status ``no_prediction``. One keyed join, so a file without breaks is no burden.
    """
    marked = lines.withColumn("_s", strip(F.col("line")))
    is_break = F.length("_s") < 2
    joined = marked.join(predicted, ["file", "line_no"], "left")
    passed = is_break | F.col("_s").startswith(DOC_MARK)
    status = (F.when(is_break, F.lit("boundary")).when(passed, F.lit("document"))
              .when(F.col("pred").isNull(), F.lit("no_prediction")).otherwise(F.lit("token")))
    out_line = F.when(passed, F.col("line")).when(
        F.col("pred").isNotNull(), F.concat_ws(" ", F.split("_s", " ")[0], "pred"))
    return joined.select("file", "line_no", out_line.alias("out_line"), status.alias("status"))
