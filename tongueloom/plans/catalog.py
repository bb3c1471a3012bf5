"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tongueloom.config import CorpusJob, MASK_PIECE, NER_TAGS
from tongueloom.functions.arrays import argmax_index
from tongueloom.functions.text import words
from tongueloom.operators import classify, clean, lm, ner, runs, sample, subword
from tongueloom.plans import growth, views
from tongueloom.plans.views import DOC_SHIFT, SEED
from tongueloom.session import fresh_path, stage
from tongueloom.sources import readers, sinks

JOB = CorpusJob()
N_MERGES = 64
VOCAB_SIZE = 140  # pieces of the vocabulary query: reserved ones, merges, letters and the mask
TOPIC_LABELS = ["de", "en", "es", "fr"]
LINEAR_BAR = 0.9  # share of held-out titles that the linear classifier must get right
QUALITY_LABELS = ["0", "1"]
NER_MAX_LEN = 164
LINES_PER_BUCKET = 64 * DOC_SHIFT
SEEDS = [1, 2, 3, 4, 5]
TASKS = ["ner", "topic", "sentiment"]
FEATURE_COLUMNS = ("input_ids", "input_mask", "segment_ids", "label_ids")

_learned: dict[tuple, tuple] = {}


def learned(spark: SparkSession, sf_dir: str) -> tuple[list, dict[str, int]]:
    """Merges and vocabulary of a corpus, trained once per application and reused as a stored vocabulary file would be.

    The corpus is known by its number of rows and an order-free sum of their hashes, so another or changed table is trained anew.
    """
    rows = views.corpus(spark, sf_dir).agg(F.count("*"), F.sum(F.xxhash64("lang", "row_id", "input").cast("decimal(38,0)"))).first()
    at = (spark.sparkContext.applicationId, *rows)
    if at not in _learned:
        merges, vocab = subword.learn(views.sentences(spark, sf_dir), N_MERGES, JOB.coverage)
        _learned[at] = (merges, subword.vocab_dict(vocab))
    return _learned[at]


def _joined(col: str) -> Column:
    return F.array_join(F.col(col).cast("array<string>"), ",").alias(col)


# ---- shared steps ------------------------------------------------------------

def splits(spark, sf):
    return sample.split(views.corpus(spark, sf), JOB.holdout, SEED)


def split_lines(spark, sf, part):
    s = splits(spark, sf).where(F.col("split") == part)
    return clean.to_sentences(s, keep=["digest"])


def train_lines(spark, sf):
    return clean.min_words(split_lines(spark, sf, "train"), JOB.min_words)


def eval_lines(spark, sf):
    return clean.min_words(split_lines(spark, sf, "eval"), JOB.min_words)


def window_lines(spark, sf):
    return clean.len_window(split_lines(spark, sf, "eval"), JOB.window_lo, JOB.window_hi)


def drawn(spark, sf):
    return sample.bootstrap(window_lines(spark, sf), SEED, "draw")


def long_lines(spark, sf):
    return clean.min_words(views.sentences(spark, sf), JOB.min_words)


def encoded(spark, sf):
    return subword.encode_sequences(long_lines(spark, sf), *learned(spark, sf), JOB.max_len)


# ---- sources and sinks -------------------------------------------------------

def src_mono_corpus(spark, sf):
    out = fresh_path(spark, "mono")
    sinks.write_corpus(views.corpus(spark, sf), out, order="row_id")
    return readers.read_corpus(spark, out)


def src_lines(spark, sf):
    out = fresh_path(spark, "lines")
    sinks.write_splits(_named_lines(spark, sf), out)
    parts = [readers.number_file_lines(readers.read_lines(spark, out, part)).withColumn("part", F.lit(part)) for part in ("train", "eval")]
    return parts[0].unionByName(parts[1]).select("part", "lang", "line_no", F.md5("line").alias("line_md5")).groupBy("part", "lang").agg(
        F.count("*").alias("n_lines"), F.min("line_no").alias("first_no"), F.max("line_no").alias("last_no"),
        F.countDistinct("line_no").alias("n_numbers"), F.countDistinct("line_md5").alias("n_texts"))


def _named_lines(spark, sf):
    return clean.to_sentences(splits(spark, sf), keep=["split"]).select("lang", "split", "line")


def src_labelled_tsv(spark, sf):
    out = fresh_path(spark, "labelled")
    extra = views.topics(spark, sf).select(
        F.col("row_id").cast("string").alias("bbc_url_id"), F.lit("1 Oṣù").alias("date"), "news_title", "label")
    sinks.write_labelled(extra, out)
    return readers.read_labelled(spark, out)


def src_conll(spark, sf):
    out = fresh_path(spark, "conll-files")
    docs = views.corpus(spark, sf).repartitionByRange("lang", "row_id")  # texts move, their token lines are made once and stay
    sinks.write_conll(views.conll_lines_of(docs), out, ranged=True)
    return readers.parse_conll(readers.read_conll(spark, f"{out}/*", r"/file=([^/]+)/"))


def src_label_list(spark, sf):
    out = fresh_path(spark, "labels")
    used = views.tokens(spark, sf).select("tag").distinct().where(F.col("tag") != "O")
    used.orderBy("tag").coalesce(1).write.text(out)  # the tag set, at most two per entity type
    return readers.read_labels(spark, out)


def sink_splits(spark, sf):
    out = fresh_path(spark, "splits")
    sinks.write_splits(_named_lines(spark, sf), out)
    train = readers.read_lines(spark, out, "train").select(F.lit("train").alias("part"), "lang", "line")
    held = readers.read_lines(spark, out, "eval").select(F.lit("eval").alias("part"), "lang", "line")
    pooled = spark.read.text(f"{out}/all_eval.txt").select(
        F.lit("all_eval").alias("part"), F.lit("all").alias("lang"), F.col("value").alias("line"))
    return train.unionByName(held).unionByName(pooled)


def sink_corpus_round(spark, sf):
    out = fresh_path(spark, "rounds")
    base = views.corpus(spark, sf)
    sinks.write_round(base, out, 0)
    sinks.write_round(clean.dedup(base), out, 1)
    return sinks.read_rounds(spark, out, 1).select(F.col("round").cast("bigint"), "lang", "row_id", F.md5("input").alias("text_md5"))


def _run_metrics(spark, sf):
    per_run = views.runs(spark, sf).groupBy("task", "lang", "seed").agg(
        F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("best"))
    long = per_run.unpivot(["task", "lang", "seed"], ["n", "mean", "best"], "key", "value")
    return long.withColumn("run_id", F.concat_ws("-", "task", "lang", F.col("seed").cast("string")))


def sink_metrics(spark, sf):
    back = sinks.write_metrics(_run_metrics(spark, sf), fresh_path(spark, "metrics"))
    return sinks.metrics_text(back)


def sink_guarded(spark, sf):
    out = fresh_path(spark, "guarded")
    base = views.corpus(spark, sf).select("lang", "row_id")
    sinks.save(base, out)
    try:
        sinks.save(base, out)
        refused = False
    except FileExistsError:
        refused = True
    sinks.save(base, out, overwrite=True)
    return spark.read.parquet(out).withColumn("refused", F.lit(int(refused)))


def feature_cache(spark, sf):
    folder = fresh_path(spark, "cache")
    merges, vocab = learned(spark, sf)
    keep = ("lang", "row_id", "line_no")
    build = lambda lines: subword.encode_sequences(lines, merges, vocab, JOB.max_len, (*keep, "part"))
    key = ("test", "bigram", JOB.max_len, merges, sorted(vocab.items()))
    lines = stage(long_lines(spark, sf), "lines")
    sinks.cached_parts(lines.where(F.col("row_id") % 7 != 0), folder, build, key, keep[:2])  # an earlier state of the corpus
    hit = sinks.cached_parts(lines, folder, build, key, keep[:2])  # only parts that got further rows are encoded again
    return hit.select("lang", "row_id", "line_no", "chunk_no", _joined("input_ids"))


# ---- cleaning ----------------------------------------------------------------

def normalise_lines(spark, sf):
    return views.sentences(spark, sf)


def filter_min_words(spark, sf):
    return long_lines(spark, sf)


def filter_len_window(spark, sf):
    return clean.len_window(views.sentences(spark, sf), JOB.window_lo, JOB.window_hi)


def drop_missing(spark, sf):
    return clean.drop_missing(views.missing(spark, sf))


def label_encode(spark, sf):
    return clean.encode_labels(views.topics(spark, sf), TOPIC_LABELS).select("row_id", "label", "label_id")


def dedup_corpus(spark, sf):
    return clean.dedup(views.corpus(spark, sf))


def concat_corpora(spark, sf):
    base = views.corpus(spark, sf)
    return sample.stack_order(clean.concat_corpora([base]), SEED).select("pos", "lang", "row_id")  # every language in one scan


# ---- sampling ----------------------------------------------------------------

def shuffle_seeded(spark, sf):
    return sample.shuffle(views.corpus(spark, sf), SEED).select("lang", "row_id", "pos")


def split_holdout(spark, sf):
    return splits(spark, sf).select("lang", "row_id", "split")


def holdout_union(spark, sf):
    return sample.holdout_union(splits(spark, sf)).select("lang", "row_id", F.md5("input").alias("text_md5"))


def lang_stats(spark, sf):
    return sample.lang_stats(sample.shard(train_lines(spark, sf), JOB.workers))


def lang_probs(spark, sf):
    return sample.lang_probs(train_lines(spark, sf), JOB.alpha).withColumn("p", F.round("p", 6))


def lang_probs_smoothed(spark, sf):
    return sample.lang_probs(train_lines(spark, sf), 0.3).withColumn("p", F.round("p", 6))


def worker_shards(spark, sf):
    return sample.shard(train_lines(spark, sf), JOB.workers).select("lang", "row_id", "line_no", "shard_id")


def lang_batches(spark, sf):
    return sample.batch_plan(train_lines(spark, sf), JOB.batch_size, JOB.alpha, SEED).select(
        "batch_id", "batch_pos", "lang", "row_id", "line_no")


def bootstrap_sample(spark, sf):
    return drawn(spark, sf).select("lang", "draw", "row_id", "line_no", "line")


# ---- subwords ----------------------------------------------------------------

def word_counts(spark, sf):
    return subword.word_counts(views.sentences(spark, sf))


def char_coverage(spark, sf):
    return subword.alphabet(word_counts(spark, sf), JOB.coverage)


def bpe_pair_counts(spark, sf):
    return subword.pair_counts(subword.with_symbols(word_counts(spark, sf)))


def bpe_train(spark, sf):
    merges, _ = subword.train_bpe(word_counts(spark, sf), N_MERGES)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges, 1)], "rk bigint, left string, right string")


def vocab_table(spark, sf):
    _, vocab = subword.learn(views.sentences(spark, sf), coverage=JOB.coverage, vocab_size=VOCAB_SIZE)
    return vocab


def subword_encode(spark, sf):
    merges, _ = learned(spark, sf)
    counts = word_counts(spark, sf)
    return subword.encode_words(counts, merges).select("word", F.array_join("pieces", " ").alias("pieces"))


def encode_sequences(spark, sf):
    return encoded(spark, sf).select("lang", "row_id", "line_no", "chunk_no", _joined("input_ids"))


def labelled_features(spark, sf):
    """Ids, mask and label of every title: what a classifier is trained on."""
    titles = clean.encode_labels(views.topics(spark, sf), TOPIC_LABELS).withColumnRenamed("news_title", "line")
    keep = ("row_id", "label_id")
    padded = subword.pad_sequences(subword.encode_sequences(titles, *learned(spark, sf), JOB.max_len, keep), "max_length", JOB.max_len, keep)
    return padded.select(*keep, "chunk_no", _joined("input_ids"), _joined("attention_mask"))


def pad_sequences(spark, sf):
    padded = subword.pad_sequences(encoded(spark, sf), "longest", JOB.max_len)
    return padded.select("lang", "row_id", "line_no", "chunk_no", _joined("input_ids"), _joined("attention_mask"))


# ---- masking, model, growth --------------------------------------------------

def mlm_mask(spark, sf):
    mask = learned(spark, sf)[1][MASK_PIECE]  # the last piece: random ids are drawn among those before it
    masked = lm.mlm_mask(encoded(spark, sf), mask, mask, JOB.mask_rate, SEED)
    return masked.select("lang", "row_id", "line_no", "chunk_no", _joined("input_ids"), _joined("labels"))


def ngram_fit(spark, sf):
    return lm.bigrams(train_lines(spark, sf))


def ngram_top(spark, sf):
    return lm.top_next(lm.bigrams(train_lines(spark, sf)))


def heldout_perplexity(spark, sf):
    return lm.perplexity(train_lines(spark, sf), eval_lines(spark, sf)).withColumn("perplexity", F.round("perplexity", 3))


def build_prompts(spark, sf):
    return lm.prompts(drawn(spark, sf), JOB.mask_rate).select("lang", "draw", "prompt", F.col("n_tokens").cast("bigint"))


def complete_prompts(spark, sf):
    return growth.generate(splits(spark, sf), JOB, SEED).select(
        "lang", "draw", F.col("n_tokens").cast("bigint"), "sentence")


def _echo_last_word(prompts):
    """A stand-in predictor that refuses a whole batch holding a non-ASCII prompt."""
    if not all(p.isascii() for p in prompts):
        raise ValueError("non-ASCII prompt")
    return prompts.map(lambda p: f"{p} {p.split()[-1]}")


def predict_batches(spark, sf):
    asked = lm.prompts(drawn(spark, sf), JOB.mask_rate).select("lang", "draw", "prompt")
    return lm.predict_checked(asked, _echo_last_word, fresh_path(spark, "failed-prompts"), max_share=0.95)


def augment_corpus(spark, sf):
    base = views.corpus(spark, sf)
    new = growth.generate(splits(spark, sf), JOB, SEED)
    return lm.augment(base, new, 1).select("lang", F.md5("input").alias("text_md5"), "is_generated")


def active_rounds(spark, sf):
    return growth.run_rounds(views.corpus(spark, sf), JOB)


def active_rounds_all(spark, sf):
    return growth.run_rounds(views.corpus(spark, sf), JOB)


# ---- classification ----------------------------------------------------------

def nb_classify(spark, sf):
    q = sample.split(views.quality(spark, sf), JOB.holdout, SEED)
    model = classify.nb_fit(q.where(F.col("split") == "train"), QUALITY_LABELS)
    return classify.nb_predict(q.where(F.col("split") == "eval"), model).withColumn("score", F.round("score", 4))


def linear_classify(spark, sf):
    t = clean.encode_labels(clean.drop_missing(views.topics(spark, sf)), TOPIC_LABELS)
    t = sample.split(t, JOB.holdout, SEED)
    model = classify.lr_fit(t.where(F.col("split") == "train"))
    got = classify.lr_predict(t.where(F.col("split") == "eval"), model)
    by_class = got.groupBy("label_id").agg(F.count("*").alias("n"), F.sum((F.col("label_id") == F.col("prediction")).cast("int")).alias("hit"))
    right = F.sum("hit").over(W.partitionBy()) / F.sum("n").over(W.partitionBy())  # a row per class
    return by_class.select("label_id", "n", (right >= LINEAR_BAR).alias("accurate"))


def argmax_predictions(spark, sf):
    return views.scores(spark, sf).select("vec_id", argmax_index(F.col("scores")).alias("prediction"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def classification_metrics(spark, sf):
    scored = views.scores(spark, sf).withColumn("prediction", argmax_index(F.col("scores")))
    return _rounded(classify.macro_metrics(scored), "accuracy", "precision", "recall", "f1")


def cross_domain_eval(spark, sf):
    q = views.quality(spark, sf)  # one language is the domain trained on, the others the one reported on
    got = classify.cross_eval(q.where(F.col("lang") == "en"), q.where(F.col("lang") != "en"), QUALITY_LABELS)
    return _rounded(got, "accuracy", "precision", "recall", "f1")


# ---- tagging -----------------------------------------------------------------

def conll_sentences(spark, sf):
    got = ner.conll_sentences(views.conll_lines(spark, sf), "test", LINES_PER_BUCKET)
    return got.select("file", "guid", F.array_join("words", " ").alias("words"), F.array_join("labels", " ").alias("labels"))


def align_labels(spark, sf):
    got = ner.align_labels(views.tagged(spark, sf), *learned(spark, sf), NER_TAGS, NER_MAX_LEN)
    return got.select("guid", "chunk_no", *[_joined(c) for c in FEATURE_COLUMNS])


def align_labels_left(spark, sf):
    """The other framing: class token last, extra separator, padding on the left."""
    got = ner.align_labels(views.tagged(spark, sf), *learned(spark, sf), NER_TAGS, NER_MAX_LEN, cls_at_end=True,
                           sep_extra=True, pad_left=True, cls_segment=2, pad_segment=4)
    return got.select("guid", "chunk_no", *[_joined(c) for c in FEATURE_COLUMNS])


def tag_tokens(spark, sf):
    halves = splits(spark, sf)
    lexicon = ner.fit_lexicon(views.tokens_of(halves.where(F.col("split") == "train")))
    return ner.tag(views.tokens_of(halves.where(F.col("split") == "eval")), lexicon).select(
        "row_id", "line_no", "pos", "word", "tag", "pred")


def held_tags(spark, sf):
    """Gold and predicted tags of the held-out sentences: features, a tagger fitted on the other half, scores, best labels, decoded."""
    merges, vocab = learned(spark, sf)
    halves = splits(spark, sf)
    train, held = (ner.align_labels(views.tagged_of(halves.where(F.col("split") == part)), merges, vocab, NER_TAGS, NER_MAX_LEN) for part in ("train", "eval"))
    table = spark.sparkContext.broadcast(ner.fit_piece_scores(train, len(vocab), len(NER_TAGS)))
    return ner.decoded(ner.predict_scores(held, lambda ids, mask: table.value[ids], len(NER_TAGS)))


def decode_tags(spark, sf):
    return held_tags(spark, sf).select("guid", F.array_join("labels", " ").alias("labels"), F.array_join("pred", " ").alias("pred"))


def bio_spans(spark, sf):
    got = ner.bio_spans(views.tagged(spark, sf), "pred")
    return got.select("guid", "type", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


def ner_metrics(spark, sf):
    return _rounded(ner.ner_report(stage(held_tags(spark, sf), "held-tags")), "precision", "recall", "f1")


def prediction_export(spark, sf):
    halves = splits(spark, sf)
    lexicon = ner.fit_lexicon(views.tokens_of(halves.where(F.col("split") == "train")))
    lines = stage(views.conll_lines_of(halves.where(F.col("split") == "eval")), "conll")  # stands for the input file, read twice
    pred = ner.tag(readers.parse_conll(lines).withColumn("lang", F.col("file")), lexicon).select("file", "line_no", "pred")
    return ner.export(lines, pred)


# ---- experiments -------------------------------------------------------------

def run_grid(spark, sf):
    return runs.grid(views.corpus(spark, sf), SEEDS, TASKS)


def seed_summary(spark, sf):
    return _rounded(runs.summarise(views.runs(spark, sf)), "mean", "std")


def checkpoint_compare(spark, sf):
    scored = views.runs(spark, sf).groupBy("task", "lang", "step").agg(F.round(F.avg("value"), 6).alias("value"))
    return runs.by_step(scored.withColumn("key", F.lit("f1")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        src_mono_corpus, src_lines, src_labelled_tsv, src_conll, src_label_list, sink_splits, sink_corpus_round,
        sink_metrics, sink_guarded, feature_cache,
        normalise_lines, filter_min_words, filter_len_window, drop_missing, label_encode, dedup_corpus, concat_corpora,
        shuffle_seeded, split_holdout, holdout_union, lang_stats, lang_probs, lang_probs_smoothed, worker_shards,
        lang_batches, bootstrap_sample,
        word_counts, char_coverage, bpe_pair_counts, bpe_train, vocab_table, subword_encode, encode_sequences,
        labelled_features, pad_sequences,
        mlm_mask, ngram_fit, ngram_top, heldout_perplexity, build_prompts, complete_prompts, predict_batches,
        augment_corpus, active_rounds, active_rounds_all,
        nb_classify, linear_classify, argmax_predictions, classification_metrics, cross_domain_eval,
        conll_sentences, align_labels, align_labels_left, tag_tokens, decode_tags, bio_spans, ner_metrics, prediction_export,
        run_grid, seed_summary, checkpoint_compare,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each language is drawn after cleaning and hold-out: sizes of both splits and probability."""
    lines = clean.min_words(clean.to_sentences(splits(spark, sf_dir), keep=["split"]))
    counts = lines.groupBy("lang").agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in ("train", "eval")])
    train = counts.select("lang", F.col("n_train").alias("n"), "n_eval")
    return sample.with_probs(train, JOB.alpha).select("lang", F.col("n").alias("n_train"), "n_eval", F.round("p", 6).alias("p"))
