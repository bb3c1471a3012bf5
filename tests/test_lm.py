import math
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tongueloom.config import CorpusJob
from tongueloom.operators import lm
from tongueloom.plans import catalog, growth, oracles

LINES = [
    ("a", "the cat sat on the mat and the cat ran"), ("a", "the dog sat on the log"), ("a", "on and on and stop"),
    ("b", "uno dos tres uno dos cuatro"), ("b", "tres uno"),
]


def sentences(spark, rows=LINES):
    return spark.createDataFrame([(lang, i, 0, x) for i, (lang, x) in enumerate(rows)],
                                 "lang string, row_id long, line_no long, line string")


def slow_top(rows=LINES):
    counts = defaultdict(Counter)
    for lang, x in rows:
        w = x.split()
        for p, q in zip(w, w[1:]):
            counts[lang, p][q] += 1
    return {k: min(c, key=lambda t: (-c[t], t)) for k, c in counts.items()}


def test_top_next(spark):
    got = {(r["lang"], r["prev"]): r["next"] for r in lm.top_next(lm.bigrams(sentences(spark))).collect()}
    assert got == slow_top()


def test_completion_equals_a_word_by_word_loop(spark):
    top = slow_top()
    asked = [("a", "the", 9), ("a", "mat and", 1), ("a", "stop", 4), ("a", "nowhere", 3), ("b", "uno", 30), ("b", "cuatro", 2), ("a", "x the", 17)]
    df = spark.createDataFrame([(lang, i, p, n) for i, (lang, p, n) in enumerate(asked)], "lang string, draw long, prompt string, n_tokens int")
    got = {r["draw"]: r["sentence"] for r in lm.complete(df, lm.top_next(lm.bigrams(sentences(spark))), 30).collect()}
    for i, (lang, prompt, n) in enumerate(asked):
        w = prompt.split()
        for _ in range(n):
            if (lang, w[-1]) not in top:
                break
            w.append(top[lang, w[-1]])
        assert got[i] == " ".join(w)


def test_prompts_cut(spark):
    rows = [("a", " ".join(f"w{j}" for j in range(n))) for n in (5, 7, 13, 20, 255)]
    for r in lm.prompts(sentences(spark, rows)).collect():
        w = r["line"].split()
        n = int(len(w) * 0.15) + 1
        assert r["n_tokens"] == n and r["prompt"] == " ".join(w[:-n])
    assert growth.max_cut(CorpusJob()) == 39


def test_perplexity(spark):
    k, train, held = 0.5, [("a", "x y x"), ("b", "q")], [("a", "x y z"), ("b", "q q")]
    got = {r["lang"]: (r["tokens"], r["perplexity"]) for r in lm.perplexity(sentences(spark, train), sentences(spark, held), k).collect()}
    losses = defaultdict(list)
    for lang, x in held:
        text = [w for la, t in train if la == lang for w in t.split()]
        v = len(set(text)) + 1
        pairs = Counter(p for la, t in train if la == lang for p in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
        w = x.split()
        for p, q in zip(["<s>", *w], [*w, "</s>"]):
            c = sum(n for (a, _), n in pairs.items() if a == p)
            losses[lang].append(-math.log((pairs[p, q] + k) / (c + k * v)))
    losses["all"] = losses["a"] + losses["b"]
    for lang, ls in losses.items():
        assert got[lang][0] == len(ls) and abs(got[lang][1] - math.exp(sum(ls) / len(ls))) < 1e-9


def test_mask_shares_and_untouched_positions(spark):
    df = spark.createDataFrame([("a", i, 0, 0, [0, *range(10, 260), 2]) for i in range(40)],
                               "lang string, row_id long, line_no long, chunk_no long, input_ids array<long>")
    kinds = Counter()
    for r in lm.mlm_mask(df, 1000, 1000, 0.15, 4).collect():
        assert r["labels"][0] == r["labels"][-1] == -100 and (r["input_ids"][0], r["input_ids"][-1]) == (0, 2)
        for old, new, label in zip([0, *range(10, 260), 2], r["input_ids"], r["labels"]):
            assert label in (-100, old) and (label == old or new == old)
            kinds["kept" if label == -100 else "mask" if new == 1000 else "same" if new == old else "random"] += 1
    chosen = sum(kinds.values()) - kinds["kept"]
    assert abs(chosen / 10000 - 0.15) < 0.01 and abs(kinds["mask"] / chosen - 0.8) < 0.04


def test_predictor_failures_stay_in_their_row(spark):
    def fn(batch: pd.Series) -> pd.Series:
        if (batch == "bad").any():
            raise ValueError
        return batch.str.upper()

    df = spark.createDataFrame([("x",), ("bad",), ("y",)], "prompt string").coalesce(1)
    assert [r["prediction"] for r in lm.predict(df, fn).collect()] == ["X", "", "Y"]


def test_augment_keeps_old_rows(spark):
    old = spark.createDataFrame([("a", 1, "s"), ("a", 2, "s"), ("a", 3, "t")], "lang string, row_id long, input string")
    new = spark.createDataFrame([("a", "t"), ("a", "u"), ("a", "u"), ("b", "t")], "lang string, sentence string")
    got = {(r["lang"], r["input"]): (r["row_id"], r["is_generated"]) for r in lm.augment(old, new, 2).collect()}
    assert got["a", "s"] == ("1", 0) and got["a", "t"] == ("3", 0) and got["a", "u"][1] == 1 and got["b", "t"][1] == 1 and len(got) == 4


def test_three_rounds_grow_without_losing_text(spark):
    rows = [("a", i, f"w{i % 7} w{i % 5} and the w{i % 3} of w{i % 11} went home again") for i in range(60)]
    rows += [("one", 0, "only one sentence of more than five words"), ("blank", 0, "  ")]
    corpus = spark.createDataFrame(rows, "lang string, row_id long, input string")
    stats = {(r["round"], r["lang"]): r for r in growth.run_rounds(corpus, CorpusJob(rounds=3)).collect()}
    assert {k[0] for k in stats} == {1, 2, 3}
    for k in (1, 2, 3):
        r = stats[k, "a"]
        assert r["n_new"] >= 0 and r["n_after"] <= r["n_before"] + r["n_new"]
        if k > 1:
            assert r["n_before"] == stats[k - 1, "a"]["n_after"] and r["n_after"] == r["n_before"] + r["n_new"]
    assert stats[1, "a"]["n_before"] == 60 and stats[3, "blank"]["n_after"] == 1


def test_active_rounds_runs_every_round_of_the_job(spark, tmp_path):
    rows = [(i, f"w{i % 7} w{i % 5} and the w{i % 3} of w{i % 11} went home again", "ab"[i % 2]) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.active_rounds(spark, str(tmp_path)).collect()
    assert sorted((r["round"], r["lang"]) for r in got) == [(k, lang) for k in range(1, CorpusJob().rounds + 1) for lang in "ab"]
    sql = oracles.build()["active_rounds"]
    assert all(f"corpus_{k + 1} AS" in sql for k in range(1, CorpusJob().rounds + 1))


def test_held_lines_are_made_once(spark, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), growth.clean.len_window

    def counted(*args):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return whole(*args).mapInArrow(run, whole(*args).schema)

    monkeypatch.setattr(growth.clean, "len_window", counted)
    rows = [("ab"[i % 2], i, f"w{i % 7} w{i % 5} and the w{i % 3} of w{i % 11} went home again") for i in range(90)]
    splits = growth.sample.split(spark.createDataFrame(rows, "lang string, row_id long, input string"), 0.2, 1)
    assert seen.value == 0 and len(growth.generate(splits, CorpusJob(), 1).collect()) == seen.value == 18


def test_failed_predictions_are_kept_and_counted(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("c",), (None,)], "prompt string")

    def fn(prompts):
        if prompts.isna().any() or prompts.str.contains("bad").any():
            raise ValueError("no such prompt")
        return prompts.str.upper()

    done = lm.predict_checked(df, fn, str(tmp_path / "ledger"))
    assert {r.prompt: (r.prediction, r.error) for r in done.collect()} == {
        "a": ("A", None), "c": ("C", None), "bad": ("", "ValueError: no such prompt"), None: ("", "ValueError: no such prompt")}
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    with pytest.raises(lm.PredictionsFailed, match="4 of 4"):
        lm.predict_checked(df, lambda p: p[:0], str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).select("error").distinct().count() == 1
    assert lm.predict_checked(df.limit(0), fn, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bits", [1 << 28, 1 << 20, 8])
def test_filter_over_digests_loses_nothing(spark, bits):
    corpus = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') as lang", "concat('s', id) as input")
    table = corpus.where("input like '%7'").selectExpr("md5(concat_ws('|', lang, input)) as digest")
    got = lm.maybe_among(corpus.selectExpr("md5(concat_ws('|', lang, input)) as digest", "input"), table, "digest", bits)
    texts = {r.input for r in got.collect()}
    assert {f"s{i}" for i in range(4000) if i % 10 == 7} <= texts and (len(texts) < 420 if bits > 8 else len(texts) == 4000)
    made = spark.createDataFrame([("a", "s2"), ("a", "s3"), ("a", "s3"), ("b", "s7"), ("b", "new"), ("a", "new")], "lang string, sentence string")
    fresh = lm.fresh_sentences(corpus, made, 1, bits)
    assert sorted((r.lang, r.input) for r in fresh.collect()) == [("a", "new"), ("a", "s3"), ("b", "new")]
    assert lm.fresh_sentences(corpus.limit(0), made, 1, bits).count() == 5 and lm.fresh_sentences(corpus, made.limit(0), 1, bits).count() == 0
