import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tongueloom.operators import classify, ner, runs
from tongueloom.functions import argmax_index
from tongueloom.sources import readers, sinks

TAGS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def slow_spans(tags):
    out, start, kind = [], None, None
    for i, t in enumerate([*tags, "O"]):
        x = t[2:] if t != "O" else None
        if start is not None and (x != kind or t.startswith("B-")):
            out.append((kind, start, i - 1))
            start = None
        if x is not None and start is None:
            start, kind = i, x
    return out


def tag_rows(n=200, seed=3):
    rng = random.Random(seed)
    return [[rng.choice(TAGS) for _ in range(rng.randint(0, 9))] for _ in range(n)]


def test_spans_equal_a_loop(spark):
    rows = tag_rows() + [[], ["I-PER"], ["I-PER", "I-LOC"], ["B-PER", "B-PER", "I-PER"], ["O", "I-LOC", "I-LOC", "O"]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "guid string, labels array<string>")
    got = defaultdict(list)
    for r in ner.bio_spans(df).orderBy("start").collect():
        got[int(r["guid"])].append((r["type"], r["start"], r["end"]))
    assert {i: s for i, t in enumerate(rows) if (s := slow_spans(t))} == got


def test_report(spark):
    gold, pred = tag_rows(120, 1), tag_rows(120, 2)
    pred = [(p * 9)[: len(g)] if p else ["O"] * len(g) for g, p in zip(gold, pred)]
    df = spark.createDataFrame(list(zip(gold, pred)), "labels array<string>, pred array<string>")
    got = {r["type"]: r for r in ner.ner_report(df).collect()}
    g = {(i, *s) for i, t in enumerate(gold) for s in slow_spans(t)}
    p = {(i, *s) for i, t in enumerate(pred) for s in slow_spans(t)}
    assert abs(got["micro avg"]["precision"] - len(g & p) / len(p)) < 1e-12 and got["micro avg"]["support"] == len(g)
    per = {x for x in g if x[1] == "PER"}
    assert got["PER"]["support"] == len(per) and abs(got["PER"]["recall"] - len(per & p) / len(per)) < 1e-12
    same = {r["type"]: r["f1"] for r in ner.ner_report(df.withColumn("pred", F.col("labels"))).collect()}
    assert set(same.values()) == {1.0}


CONLL = "-DOCSTART- O\n\nJohn B-PER\nSmith  I-PER\n.\nlives\n\n\n \nin O\nNew B-LOC extra I-LOC\n\na b"


def slow_conll(text):
    out, words, tags = [], [], []
    for line in [*text.split("\n"), ""]:
        line = line.strip()
        if len(line) < 2:
            if words:
                out.append((words, tags))
            words, tags = [], []
            continue
        f = line.split(" ")
        words.append(f[0])
        tags.append(f[-1] if len(f) > 1 else "O")
    return out


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_conll_sentences(spark, per_bucket):
    rows = [(f, i, x) for f in ("f", "g") for i, x in enumerate(CONLL.split("\n"))]
    df = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = ner.conll_sentences(df, "dev", per_bucket).where("file = 'g'").collect()
    got = sorted(got, key=lambda r: int(r["guid"].split("-")[1]))
    assert [(r["words"], r["labels"]) for r in got] == slow_conll(CONLL)
    assert [r["guid"] for r in got] == [f"dev-{i}" for i in range(1, len(got) + 1)]


def test_export(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(CONLL.split("\n"))], "file string, line_no long, line string")
    pred = spark.createDataFrame([("f", 2, "B-X"), ("f", 3, "I-X")], "file string, line_no long, pred string")
    got = [(r["out_line"], r["status"]) for r in ner.export(df, pred).orderBy("line_no").collect()]
    assert got[:5] == [("-DOCSTART- O", "document"), ("", "boundary"), ("John B-X", "token"), ("Smith I-X", "token"), (".", "boundary")]
    assert got[5] == (None, "no_prediction") and got[8] == (" ", "boundary")


def test_text_sinks(spark, tmp_path):
    rows = [("f.txt", i, f"w{i} O" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, line_no long, out_line string").repartition(5)
    sinks.write_predictions(df, str(tmp_path / "p"))
    parts = sorted((tmp_path / "p" / "file=f.txt").glob("part-*"))
    got = [x for part in parts for x in part.read_text().splitlines()]
    assert got == [x for _, _, x in rows if x]
    m = spark.createDataFrame([("r", "f1", 0.5), ("r", "accuracy", 0.25)], "run_id string, key string, value double")
    sinks.write_metrics_text(m, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m" / "run_id=r")).collect()] == ["accuracy = 0.250000", "f1 = 0.500000"]
    lines = spark.createDataFrame([("en", f"s {i}") for i in range(20)], "lang string, line string").withColumn("split", F.lit("eval"))
    sinks.write_splits(lines, str(tmp_path / "s"), compact=True)
    assert readers.read_lines(spark, str(tmp_path / "s"), "eval").count() == 20
    assert spark.read.text(str(tmp_path / "s" / "all_eval.txt")).count() == 20


def test_align_labels(spark):
    vocab = {"▁": 5, "a": 6, "b": 7, "ab": 8}
    df = spark.createDataFrame([("g", ["ab", "b", "q"], ["B-PER", "I-PER", "O"])], "guid string, words array<string>, labels array<string>")
    plain = ner.align_labels(df, [("a", "b")], vocab, TAGS, 10).first()
    assert plain["input_ids"] == [0, 5, 8, 5, 7, 5, 3, 2, 1, 1]
    assert plain["label_ids"] == [-100, 1, -100, 2, -100, 0, -100, -100, -100, -100]
    assert plain["input_mask"] == [1] * 8 + [0] * 2
    framing = dict(cls_at_end=True, sep_extra=True, pad_left=True, cls_segment=2, pad_segment=4)
    two = ner.align_labels(df, [("a", "b")], vocab, TAGS, 8, **framing).orderBy("chunk_no").collect()
    assert [r["input_ids"] for r in two] == [[1, 5, 8, 5, 7, 2, 2, 0], [1, 1, 1, 5, 3, 2, 2, 0]]
    assert two[1]["segment_ids"] == [4, 4, 4, 0, 0, 0, 0, 2]
    many = spark.createDataFrame([("g", ["ab", "b", "abababab"] * 30, ["B-PER", "I-PER", "O"] * 30)], df.schema)
    kept = [y for r in ner.align_labels(many, [("a", "b")], vocab, TAGS, 10).orderBy("chunk_no").collect() for y in r["label_ids"] if y != -100]
    assert kept == [TAGS.index(x) for x in ["B-PER", "I-PER", "O"] * 30]
    with pytest.raises(Exception, match="unknown tag: B-PER"):
        ner.align_labels(df, [], vocab, ["O"], 10).collect()


def test_decode_and_tagger(spark):
    df = spark.createDataFrame([([-100, 1, -100, 0], [4, 2, 3, 1])], "y array<long>, v array<long>")
    assert df.select(ner.decode_tags(F.col("y"), F.col("v"), TAGS).alias("t")).first()["t"] == ["I-PER", "B-PER"]
    train = spark.createDataFrame([("l", "w", "B-PER"), ("l", "w", "O"), ("l", "v", "B-LOC")], "lang string, word string, tag string")
    got = ner.tag(spark.createDataFrame([("l", "w"), ("l", "u"), ("m", "v")], "lang string, word string"), ner.fit_lexicon(train))
    assert {(r["lang"], r["word"]): r["pred"] for r in got.collect()} == {("l", "w"): "B-PER", ("l", "u"): "O", ("m", "v"): "O"}


def test_macro_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, prediction string")
    m = classify.macro_metrics(df).first()
    assert m["accuracy"] == 0.5
    assert abs(m["precision"] - (0.5 + 0.5 + 0) / 3) < 1e-12 and abs(m["recall"] - (0.5 + 1 + 0) / 3) < 1e-12
    assert abs(m["f1"] - (0.5 + 2 / 3 + 0) / 3) < 1e-12


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert df.select(argmax_index(F.col("s")).alias("i")).first()["i"] == 1


def test_bayes(spark):
    train = spark.createDataFrame([(1, "good good film", "p"), (2, "bad film", "n"), (3, "bad", "n")], "row_id long, input string, label string")
    test = spark.createDataFrame([(7, "good"), (8, "bad bad"), (9, "zzz")], "row_id long, input string")
    got = {r["row_id"]: r["prediction"] for r in classify.nb_predict(test, classify.nb_fit(train, ["n", "p"])).collect()}
    assert got == {7: "p", 8: "n", 9: "n"}


def test_runs(spark):
    langs = spark.createDataFrame([("a",), ("b",), ("a",)], "lang string")
    assert runs.grid(langs, [1, 2], ["t"]).count() == 4
    m = spark.createDataFrame([("t", "a", s, 1, "f1", v) for s, v in ((1, 1.0), (1, 3.0), (2, 4.0))],
                              "task string, lang string, seed long, step long, key string, value double")
    got = {(r["task"], r["lang"]): (r["n"], r["mean"]) for r in runs.summarise(m).collect()}
    assert got == {("t", "a"): (2, 3.0), ("t", "all"): (2, 3.0), ("all", "all"): (2, 3.0)}
    steps = spark.createDataFrame([("t", "a", 1, "f1", 0.5), ("t", "a", 2, "f1", 0.5), ("t", "a", 3, "f1", 0.2)],
                                  "task string, lang string, step long, key string, value double")
    assert {r["name"]: r["is_best"] for r in runs.by_step(steps).collect()} == {"1_f1": 1, "2_f1": 0, "3_f1": 0}


def test_plain_files(spark, tmp_path):
    (tmp_path / "hau_mono.tsv").write_text('input\tother\n"one\ntwo"\tx\n" say ""hi"" "\ty\nplain\tz\n', encoding="utf-8")
    (tmp_path / "yor_mono.tsv").write_text("input\nkan\n", encoding="utf-8")
    got = sorted((r["lang"], r["input"]) for r in readers.read_corpus(spark, str(tmp_path)).collect())
    assert got == [("hau", ' say "hi" '), ("hau", "one\ntwo"), ("hau", "plain"), ("yor", "kan")]
    (tmp_path / "train.hau").write_text("l1\nl2\nl3", encoding="utf-8")
    (tmp_path / "eval.hau").write_text("e1", encoding="utf-8")
    (tmp_path / "all_eval.txt").write_text("e1", encoding="utf-8")
    lines = readers.number_file_lines(readers.read_lines(spark, str(tmp_path), "train")).collect()
    assert sorted((r["lang"], r["line_no"], r["line"]) for r in lines) == [("hau", 1, "l1"), ("hau", 2, "l2"), ("hau", 3, "l3")]
    assert [(r["lang"], r["line"]) for r in readers.read_lines(spark, str(tmp_path), "eval").collect()] == [("hau", "e1")]
    (tmp_path / "labels.txt").write_text("B-X\nI-X\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "labels.txt")).collect()] == [("O", 0), ("B-X", 1), ("I-X", 2)]
    assert readers.read_labels(spark).count() == 9
    (tmp_path / "dev.txt").write_text(CONLL, encoding="utf-8")
    assert ner.conll_sentences(readers.read_conll(spark, str(tmp_path / "dev.txt"))).count() == len(slow_conll(CONLL))


def test_scores_to_tags(spark):
    labels = ["O", "B-X", "I-X"]
    rows = [("b", 0, [0, 5, 6, 2], [1, 1, 1, 1], [-100, 1, 2, -100]), ("b", 1, [0, 7, 2, 1], [1, 1, 1, 0], [-100, 0, -100, -100]),
            ("a", 0, [0, 8, 9, 2], [1, 1, 1, 1], [-100, 0, -100, -100]), ("c", 0, [0, 2, 1, 1], [1, 1, 0, 0], [-100] * 4)]
    df = spark.createDataFrame(rows, "guid string, chunk_no long, input_ids array<long>, input_mask array<long>, label_ids array<long>").repartition(3)
    table = ner.fit_piece_scores(df, 10, 3)
    assert table.sum() == 4 and table[5, 1] == table[6, 2] == table[7, 0] == table[8, 0] == 1
    flat = np.zeros((10, 3))
    flat[5] = [0, 2, 2]  # a tie: the first label
    flat[8] = [1, 0, 3]
    scored = ner.predict_scores(df, lambda ids, mask: flat[ids], 3, rows=2)
    assert all(len(r.scores) == 4 and len(r.scores[0]) == 3 for r in scored.collect())
    got = {r.guid: (r.labels, r.pred) for r in ner.decoded(scored, labels).collect()}
    assert got == {"a": (["O"], ["I-X"]), "b": (["B-X", "I-X", "O"], ["B-X", "O", "O"]), "c": ([], [])}
    with pytest.raises(Exception, match="the predictor returned"):
        ner.predict_scores(df, lambda ids, mask: flat[ids][:, :2], 3).collect()
    assert ner.decoded(ner.predict_scores(df.limit(0), lambda ids, mask: flat[ids], 3), labels).count() == 0


def test_words_for_missing_values(spark):
    from tongueloom.operators import clean

    df = spark.createDataFrame([("t", "a", 1), ("NA", "a", 1), ("t", "nan", 1), ("t", "a", None), ("nation", "null ", 2)], "news_title string, label string, n int")
    assert [tuple(r) for r in clean.drop_missing(df).collect()] == [("t", "a", 1), ("nation", "null ", 2)]
    assert clean.drop_missing(df, missing=()).count() == 4


def test_quoted_breaks_over_split_blocks(spark, tmp_path):
    rnd = random.Random(3)
    pieces = ["word", "two words", '"', '""', "\n", "\n\n", "\t", " ", "x" * 90, 'end"', "\\"]
    rows = {lang: ["".join(rnd.choices(pieces, k=rnd.randint(1, 6))) for _ in range(150)] for lang in ("hau", "yor")}
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if rnd.random() < 0.3 or set(x) & set('"\n\t') or not x.strip() else x
    for lang, texts in rows.items():
        for part in range(3):
            own = texts[50 * part: 50 * part + 50]
            body = "\n".join(f"{k}\t{quoted(x)}" + ("\n" if k % 7 == 0 else "") for k, x in enumerate(own))
            (tmp_path / f"{lang}_mono.tsv").mkdir(exist_ok=True)
            (tmp_path / f"{lang}_mono.tsv" / f"part-{part}.csv").write_text(f"id\tinput\n{body}\n", encoding="utf-8", newline="")
    (tmp_path / "odd_mono.tsv").write_text('id\tinput\n1\t5" pipe\n2\ta "b" c\n3\tplain\r\n', encoding="utf-8", newline="")
    for size in ("64", "333", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {(r.lang, r.row_id): r.input for r in readers.read_corpus(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = {(lang, k): x for lang, texts in rows.items() for k, x in enumerate(texts, 1)}
        assert got == want | {("odd", 1): '5" pipe', ("odd", 2): 'a "b" c', ("odd", 3): "plain"}, size


def test_split_blocks_keep_line_numbers(spark, tmp_path):
    (tmp_path / "train.xx").write_text("\n".join(f"line {i}" for i in range(5000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = readers.read_lines(spark, str(tmp_path), "train")
        assert read.rdd.getNumPartitions() > 5
        got = {r["line_no"]: r["line"] for r in readers.number_file_lines(read).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: f"line {i}" for i in range(5000)}


def test_metrics_are_appended_once(spark, tmp_path):
    schema = "run_id string, task string, lang string, seed long, key string, value double"
    one = spark.createDataFrame([("r", "t", "en", 1, "f1", 0.5), ("r", "t", "en", 1, "n", 3.0)], schema)
    more = spark.createDataFrame([("r", "t", "en", 1, "f1", 0.5), ("s", "t", "en", 2, "f1", 0.6)], schema)
    for df in (one, one, more):
        sinks.write_metrics(df, str(tmp_path / "metrics"))
    assert sorted((r.run_id, r.key) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()) == [("r", "f1"), ("r", "n"), ("s", "f1")]


def test_guard_and_cache(spark, tmp_path):
    df = spark.range(3)
    sinks.save(df, str(tmp_path / "o"))
    with pytest.raises(FileExistsError):
        sinks.save(df, str(tmp_path / "o"))
    (tmp_path / "none").mkdir()
    sinks.save(df, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 3
    sinks.save(spark.range(5), str(tmp_path / "o"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
    calls = []

    def build():
        calls.append(1)
        return spark.range(2)

    for refresh in (False, False, True):
        assert sinks.cached(spark, str(tmp_path), build, ("dev", "m", 8), refresh).count() == 2
    assert len(calls) == 2 and sinks.cache_key("a", "b") != sinks.cache_key("ab")


def test_only_changed_parts_are_built(spark, tmp_path):
    built, folder = [], str(tmp_path / "cache")
    rows = [(i, f"text {i}") for i in range(200)]

    def build(df):
        out = df.selectExpr("part", "id", "upper(text) as text").where("id <> 5")
        if df.count():
            built.append(sorted({r.part for r in df.collect()}))
        return out

    def run(rows):
        df = spark.createDataFrame(rows, "id long, text string").repartition(3)
        return sorted(map(tuple, sinks.cached_parts(df, folder, build, ("v1",), ["id"], parts=16).collect()))

    want = lambda rows: sorted((i, t.upper()) for i, t in rows if i != 5)
    assert run(rows) == want(rows) and len(built) == 1 and len(built[0]) == 16
    assert run(rows[::-1]) == want(rows) and len(built) == 1
    changed = [(i, "other" if i == 9 else t) for i, t in rows]
    assert run(changed) == want(changed) and len(built) == 2 and len(built[1]) == 1
    fewer = changed[:3]
    assert run(fewer) == want(fewer) and run([(5, "x")]) == [] and run([]) == []

    n = len(built)

    def dies(df):
        out = build(df)
        if built[n:]:
            out.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/left-over")
            raise RuntimeError("killed between files")
        return out

    df = spark.createDataFrame(rows, "id long, text string")
    with pytest.raises(RuntimeError):
        sinks.cached_parts(df, folder, dies, ("v1",), ["id"], parts=16).collect()
    assert run(rows) == want(rows)


def test_a_half_written_cache_is_no_hit(spark, tmp_path):
    path = tmp_path / f"features-{sinks.cache_key('k')}"
    spark.range(9).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert sinks.cached(spark, str(tmp_path), lambda: spark.range(2), ("k",)).count() == 2
    assert sinks.cached(spark, str(tmp_path), lambda: spark.range(4), ("k",)).count() == 2


def test_title_fit_keeps_no_words_and_equals_the_plain_pipeline(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(f"{c}1 {c}2 {c}3 the of".split()) for _ in range(rng.randint(1, 9)))) for _ in range(40) for k, c in enumerate("xyz")]
    df = spark.createDataFrame(rows, "label_id long, news_title string")
    stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=64), IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(labelCol="label_id", featuresCol="features", family="multinomial", maxIter=5)]
    plain = Pipeline(stages=stages).fit(df.select("label_id", F.split("news_title", " ").alias("words")))
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *_: kept.append(self.columns) or self)
    monkeypatch.setattr(DataFrame, "cache", lambda self: kept.append(self.columns) or self)
    model = classify.lr_fit(df, features=64, max_iter=5)
    assert not kept
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray(), plain.stages[-1].coefficientMatrix.toArray(), atol=1e-6)
    assert classify.lr_predict(df, model).columns == ["label_id", "news_title", "prediction"]


@pytest.mark.parametrize("per_bucket", [1, 2, 7, 50, 10_000])
def test_sentences_go_on_across_buckets(spark, per_bucket):
    rng = random.Random(per_bucket)
    texts = {f: [rng.choice(["", " ", "-", "a B-X", "bb O", "c", "dd x I-Y", "\u00e9\u00e9 O", "e\tf O"] if f != "none" else ["aa O", "b I-Z"]) for _ in range(n)]
             for f, n in (("f", 300), ("g", 41), ("none", 60), ("breaks", 0))} | {"breaks": [""] * 30, "late": [""] * 90 + ["aa O"]}
    rows = [(f, 3 * i + 5, x) for f, t in texts.items() for i, x in enumerate(t)]
    rng.shuffle(rows)
    rows += [(None, 1, "aa O"), ("f", None, "aa O"), ("f", 11, None)]
    got = ner.conll_sentences(spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5), "dev", per_bucket).collect()
    for f, t in texts.items():
        mine = sorted((int(r["guid"].split("-")[1]), r["words"], r["labels"]) for r in got if r["file"] == f)
        assert [x[1:] for x in mine] == [tuple(x) for x in slow_conll("\n".join(t))] and [x[0] for x in mine] == list(range(1, len(mine) + 1)), f
    assert {r["file"] for r in got} <= set(texts)


def test_lines_of_sentences_move_packed(spark):
    lines = spark.range(40_000).selectExpr("if(id div 9000 % 2 = 0, 'a', 'b') as file", "id div 10000 as bucket", "id as no", "concat('w', id % 97) as word", "'O' as tag")
    rows = lines.mapInArrow(ner._packed, "file string, bucket long, no binary, word binary, word_size binary, tag binary, tag_size binary")
    assert rows.count() < 100
    got = [r for part in rows.repartition(1).sortWithinPartitions("file", "bucket").mapInArrow(
        ner._pieces, "file string, bucket long, piece long, gap long, words array<string>, labels array<string>").collect() for r in (part["words"] or [])]
    assert sorted(got) == sorted(f"w{i % 97}" for i in range(40_000))
