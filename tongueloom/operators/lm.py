"""Masking, a count-based next-token model, perplexity, sentence completion and corpus growth."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tongueloom.config import BOS_ID, EOS_ID, IGNORE_LABEL_ID, PAD_ID
from tongueloom.functions.hashing import SPAN
from tongueloom.functions.text import words
from tongueloom.operators.clean import dedup
from tongueloom.session import lookup_join, stage

END = "</s>"
START = "<s>"
UNROLL = 8  # steps of a frontier in one job


def mlm_mask(encoded: DataFrame, mask_id: int, vocab_size: int, rate: float = 0.15, seed=1234) -> DataFrame:
    """Choose ``rate`` of the non-special positions; of those 80% become the mask, 10% a random id,
    10% stay. ``labels`` holds the original id at chosen positions, -100 elsewhere.

    One md5 per position: word 0 chooses, word 1 picks the action, word 2 the random id.
    """
    words_of = _mask_udf(mask_id, vocab_size, rate)
    key = F.concat_ws("|", *[F.lit(str(seed)), *[F.col(c).cast("string") for c in ("row_id", "line_no", "chunk_no")]])
    return encoded.withColumn("_z", words_of(key, F.col("input_ids"))).select(
        "lang", "row_id", "line_no", "chunk_no", F.col("_z.ids").alias("input_ids"), F.col("_z.labels").alias("labels")
    )


def _mask_udf(mask_id: int, vocab_size: int, rate: float):
    """Column function: key of a sequence, its ids -> ``(ids, labels)``; the md5 of position i is that of ``key|i``."""
    limit = lambda share: int(share * SPAN)

    def digests(key: str, n: int) -> bytes:
        base, out = md5(f"{key}|".encode(), usedforsecurity=False), []
        for i in range(n):
            own = base.copy()
            own.update(b"%d" % i)
            out.append(own.digest())
        return b"".join(out)

    @F.arrow_udf("struct<ids:array<bigint>,labels:array<bigint>>")
    def masked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, lists in batches:
            x = lists.flatten().to_numpy()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = b"".join(map(digests, keys.to_pylist(), sizes.tolist()))
            word = np.frombuffer(raw, dtype=">u4").reshape(-1, 4).astype(np.int64)
            chosen = ~np.isin(x, [BOS_ID, PAD_ID, EOS_ID]) & (word[:, 0] < limit(rate))
            made = np.where(word[:, 1] < limit(0.8), mask_id, np.where(word[:, 1] < limit(0.9), word[:, 2] % vocab_size, x))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())
            both = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.where(chosen, made, x), np.where(chosen, x, IGNORE_LABEL_ID))]
            yield pa.StructArray.from_arrays(both, names=["ids", "labels"])

    return masked


# ---- next-token model --------------------------------------------------------

def _pair_rows(sentences: DataFrame, ends: bool) -> DataFrame:
    w = words(F.col("line"))
    if ends:
        w = F.concat(F.array(F.lit(START)), w, F.array(F.lit(END)))
    m = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), m).alias("prev"), F.slice("w", F.lit(2), m).alias("next"))
    return (
        sentences.select("lang", w.alias("w")).select("lang", F.explode(pairs).alias("q"))
        .select("lang", "q.prev", "q.next")
    )


def bigrams(sentences: DataFrame, ends: bool = False) -> DataFrame:
    """(lang, prev, next, n) over adjacent words; ``ends`` adds sentence start and end tokens."""
    return _pair_rows(sentences, ends).groupBy("lang", "prev", "next").agg(F.count("*").alias("n"))


def top_next(counts: DataFrame) -> DataFrame:
    """Best continuation of each context (ties: smallest token) with the context's totals.

    An aggregate, not a ranking window: a context with many followers is reduced before the shuffle.
    """
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("next").alias("next")))
    return (
        counts.groupBy("lang", "prev")
        .agg(best.alias("best"), F.sum("n").alias("n_prev"), F.count("*").alias("n_next"))
        .select("lang", "prev", F.col("best.next").alias("next"), (-F.col("best.neg")).alias("n"), "n_prev", "n_next")
    )


def perplexity(train: DataFrame, heldout: DataFrame, k: float = 0.1) -> DataFrame:
    """exp(mean add-k bigram loss) per language and over all held-out tokens (lang ``all``).

    Training and held-out bigrams are counted side by side in one aggregate, so nothing is joined by
    word. The loss splits into a bigram part and a context part, which are summed apart.
    """
    sides = [_pair_rows(df, ends=True).withColumns({"c": F.lit(c).cast("bigint"), "n": F.lit(1 - c).cast("bigint")})
             for df, c in ((train, 1), (heldout, 0))]
    pairs = stage(sides[0].unionByName(sides[1]).groupBy("lang", "prev", "next").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n")), "pairs")
    # every word follows something, so the distinct followers are the word types and the end token
    types = pairs.where(F.col("c") > 0).select("lang", "next").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    kk = F.lit(float(k))
    by_pair = pairs.where(F.col("n") > 0).groupBy("lang").agg(
        F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.log(F.col("c") + kk)).alias("loss"))
    contexts = pairs.groupBy("lang", "prev").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).where(F.col("n") > 0)
    by_context = lookup_join(contexts, types, ["lang"]).groupBy("lang").agg(
        F.lit(0).cast("bigint").alias("tokens"),
        F.sum(F.col("n") * F.log(F.col("c") + kk * F.coalesce("v", F.lit(1)))).alias("loss"))
    return (
        by_pair.unionByName(by_context).groupingSets([["lang"], []], "lang")
        .agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))
        .select(F.coalesce("lang", F.lit("all")).alias("lang"), "tokens",
                F.exp(F.col("loss") / F.col("tokens")).alias("perplexity"))
    )


# ---- generation --------------------------------------------------------------

def prompts(drawn: DataFrame, rate: float = 0.15) -> DataFrame:
    """Cut the last int(rate * words) + 1 words of each line: adds ``prompt`` and ``n_tokens``."""
    w = words(F.col("line"))
    cut = (F.floor(F.size("_w") * F.lit(float(rate))) + 1).cast("int")
    return (
        drawn.withColumn("_w", w).withColumn("n_tokens", cut)
        .withColumn("prompt", F.array_join(F.slice("_w", F.lit(1), F.size("_w") - F.col("n_tokens")), " "))
        .drop("_w")
    )


def reachable(start: DataFrame, top: DataFrame, max_steps: int, unroll: int = UNROLL) -> DataFrame:
    """The contexts (lang, tok) of ``start`` and all that following ``top`` leads to within ``max_steps``.

    Only the frontier walks: each pass follows it for ``unroll`` steps, joined with the model's unique contexts, and goes on with the contexts not
    met before, until there are none.
    """
    step = top.select("lang", F.col("prev").alias("tok"), "next")
    seen = frontier = stage(start.select("lang", "tok").distinct(), "frontier")
    done = 0
    while done < max_steps and not frontier.isEmpty():
        walk, now = [], frontier
        for _ in range(min(unroll, max_steps - done)):
            now = now.join(step, ["lang", "tok"]).select("lang", F.col("next").alias("tok"))  # one row each: a context has one best token
            walk.append(now)
            done += 1
        frontier = stage(reduce(DataFrame.unionByName, walk).distinct().join(seen, ["lang", "tok"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def continuation_paths(top: DataFrame, contexts: DataFrame, tokens: int) -> DataFrame:
    """(lang, tok, path): the next ``tokens`` tokens or more from each of the ``contexts`` (lang, tok), which holds all that it leads to.

    Path doubling: a path of length m joined with the path of its last token has length 2m. A path
    whose token has no continuation stays short. Many paths end in the same few tokens, hence the
    skew-safe lookup. Each level is staged, so plans do not nest.
    """
    steps = top.select("lang", F.col("prev").alias("tok"), F.array("next").alias("path"))
    paths, length = stage(steps.join(contexts, ["lang", "tok"], "left_semi"), "paths"), 1
    while length < tokens:
        tails = paths.select("lang", F.col("tok").alias("_last"), F.col("path").alias("_tail"))
        longer = (
            lookup_join(paths.withColumn("_last", F.element_at("path", -1)), tails, ["lang", "_last"], staged=True)
            .select("lang", "tok", _append("path", "_tail").alias("path"))
        )
        paths, length = stage(longer, "paths"), 2 * length
    return paths


def _append(path: str, tail: str) -> Column:
    return F.concat(F.col(path), F.coalesce(F.col(tail), F.array().cast("array<string>")))


def complete(prompted: DataFrame, top: DataFrame, max_tokens: int) -> DataFrame:
    """Append the best next token ``n_tokens`` times, stopping where there is none: adds ``sentence``.

    ``max_tokens`` bounds n_tokens. The model is probed by the last word of a prompt, which may be a hot key: the first token directly, all
    others by one lookup of a path. Paths are made only for contexts that some prompt reaches. ``prompted`` is read twice.
    """
    top = stage(top.select("lang", "prev", "next"), "top")
    first = top.select("lang", F.col("prev").alias("_last"), F.col("next").alias("_first"))
    out = lookup_join(prompted.withColumn("_last", F.element_at(words(F.col("prompt")), -1)), first, ["lang", "_last"], staged=True)
    out = stage(out.drop("_last"), "first-tokens")
    asked = out.where((F.col("n_tokens") > 1) & F.col("_first").isNotNull())
    longest = min(max_tokens, asked.agg(F.max("n_tokens")).first()[0] or 1)
    follows = top.select("lang", F.col("next").alias("prev")).distinct()
    inner = stage(top.join(follows, ["lang", "prev"], "left_semi"), "inner-contexts")  # all that a step can lead on from
    contexts = reachable(asked.select("lang", F.col("_first").alias("tok")), inner, longest - 2)
    paths = continuation_paths(inner, contexts, longest - 1).select("lang", F.col("tok").alias("_first"), F.col("path").alias("_tail"))
    out = lookup_join(out, paths, ["lang", "_first"], staged=True)
    path = F.concat(F.filter(F.array("_first"), lambda x: x.isNotNull()), F.coalesce("_tail", F.array().cast("array<string>")))
    added = F.slice(path, F.lit(1), F.col("n_tokens"))
    return out.withColumn("sentence", F.array_join(F.concat(F.array("prompt"), added), " ")).drop("_first", "_tail")


def predict(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "prompt", out: str = "prediction", error: str = "error") -> DataFrame:
    """Run a user's batch predictor over ``text``; a row it fails on gets ``''`` and its message in ``error``, which is null elsewhere.

    A failing batch, or one with another number of results, is retried row by row, so one bad row does not blank its neighbours.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def called(values: pd.Series) -> list:
        got = list(fn(values))
        if len(got) != len(values):
            raise ValueError(f"{len(got)} predictions for {len(values)} rows")
        return got

    def one(value: str) -> tuple[str, str | None]:
        try:
            return called(pd.Series([value]))[0], None
        except Exception as e:
            return "", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got, errors = called(batch[text]), None
            except Exception:
                both = [one(v) for v in batch[text]]
                got, errors = [x for x, _ in both], [e for _, e in both]
            yield batch.assign(**{out: pd.Series(got, index=batch.index, dtype=object), error: pd.Series(errors, index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


class PredictionsFailed(RuntimeError):
    """More rows failed than a job allows."""


def predict_checked(df: DataFrame, fn: Callable[[pd.Series], pd.Series], ledger: str, max_share: float = 0.5, **more) -> DataFrame:
    """``predict``, with the failed rows and their messages written to the folder ``ledger``; above ``max_share`` of failed rows the job ends.

    Predictions are staged once, so the predictor is not run again by what follows. The ledger is written before the job is ended.
    """
    done = stage(predict(df, fn, **more), "predictions")
    failed = F.col(more.get("error", "error")).isNotNull()
    done.where(failed).write.mode("overwrite").parquet(ledger)
    n = done.agg(F.count("*").alias("rows"), F.count_if(failed).alias("failed")).first()
    if n.failed > max_share * n.rows:
        raise PredictionsFailed(f"{n.failed} of {n.rows} rows failed, see {ledger}")
    return done


def maybe_among(df: DataFrame, table: DataFrame, digest: str, bits: int = 1 << 28, number: Column | None = None) -> DataFrame:
    """The rows of ``df`` whose md5 may be among those of ``table``: none that is among them is lost, few others stay.

    Another hash than the hex digits of an md5 in ``digest`` is given as the expression ``number``, not negative, of columns of both.

    A Bloom filter with one hash: ``table`` sets bits of at most ``bits``, in maps of 4 KB that are made and joined distributed, so what is broadcast
    is bounded by ``bits`` (32 MB) whatever the tables. A filter that has become full only lets more rows through.
    """
    spot = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") if number is None else number) % bits
    area, place = F.floor(spot / 32768), spot % 32768
    maps = table.select(area.alias("_area"), place.alias("_place")).groupBy("_area").agg(F.bitmap_construct_agg("_place").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_place div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.expr("cast(shiftleft(1, cast(_place % 8 as int)) as int)").bitwiseAND(byte) != 0
    placed = df.withColumns({"_area": area, "_place": place})
    return placed.join(F.broadcast(stage(maps, "bloom")), "_area").where(hit).select(*df.columns)


def fresh_sentences(corpus: DataFrame, generated: DataFrame, round_no: int, bits: int = 1 << 28) -> DataFrame:
    """Generated sentences a corpus does not hold yet, once each: (lang, row_id, input, is_generated).

    Texts are compared by 128-bit digests. The corpus is scanned once and not shuffled: what passes a filter over the generated
    digests is joined exactly, as digests. No sentence is broadcast. ``row_id`` is named after round and text.
    """
    keys = ["lang", "digest"]
    named = F.md5(F.concat_ws("|", "lang", "input")).alias("digest")
    new = stage(generated.select("lang", F.col("sentence").alias("input")).distinct().select("lang", "input", named), "new")
    known = maybe_among(corpus.select("lang", named), new, "digest", bits).distinct()
    return new.join(known, keys, "left_anti").select(
        "lang", F.concat_ws(":", F.lit(f"r{round_no}"), F.md5("input")).alias("row_id"), "input", F.lit(1).alias("is_generated"))


def as_old(corpus: DataFrame) -> DataFrame:
    """The distinct sentences of a first corpus in the columns of a grown one."""
    return dedup(corpus).select("lang", F.col("row_id").cast("string"), "input", F.lit(0).alias("is_generated"))


def augment(corpus: DataFrame, generated: DataFrame, round_no: int) -> DataFrame:
    """Old and generated sentences, distinct inside a language; an old row wins over a generated copy."""
    return as_old(corpus).unionByName(fresh_sentences(corpus, generated, round_no))
