import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tongueloom.functions import word_count, words
from tongueloom.operators import clean, rank, sample
from tongueloom.session import lookup_join


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def corpus(spark, sizes):
    rows = [(lang, i, f"text {lang} {i}") for lang, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "lang string, row_id long, input string")


def lines(spark, sizes):
    rows = [(lang, i // 3, i % 3, f"line {i}", md5(1, i // 3)) for lang, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "lang string, row_id long, line_no long, line string, digest string")


def test_rank_of_a_hot_language_equals_a_plain_sort(spark):
    sizes = {"hot": 3000, "b": 7, "c": 1}
    got = {(r["lang"], r["row_id"]): (r["pos"], r["total"]) for r in sample.shuffle(corpus(spark, sizes), 9).collect()}
    for lang, n in sizes.items():
        order = sorted(range(n), key=lambda i: (md5(9, i), i))
        assert [got[lang, i] for i in order] == [(k, n) for k in range(1, n + 1)]


def test_running_sum_by_order_buckets(spark):
    rows = [("f", i, (i * 7) % 5) for i in range(500)] + [("g", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    out = rank.running_sum(df, ["g"], F.floor(F.col("i") / 16), ["i"], "s", F.col("v")).where("g = 'f'").orderBy("i").collect()
    total, want = 0, []
    for _, _, v in rows[:500]:
        total += v
        want.append(total)
    assert [r["s"] for r in out] == want


@pytest.mark.parametrize("n", [1, 4, 5, 6, 35, 1000])
def test_split_is_exact(spark, n):
    got = sample.split(corpus(spark, {"a": n, "b": 3}), 0.2, 77).collect()
    held = {r["row_id"] for r in got if r["lang"] == "a" and r["split"] == "eval"}
    order = sorted(range(n), key=lambda i: (md5(77, i), i))
    assert held == set(order[: math.ceil(0.2 * n)])
    assert len(got) == n + 3


def test_nothing_held_out(spark):
    assert {r["split"] for r in sample.split(corpus(spark, {"a": 9}), 0.0, 1).collect()} == {"train"}


def test_stack_order_is_language_by_language(spark):
    got = sample.stack_order(corpus(spark, {"b": 40, "a": 25}), 5).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 66))
    assert [r["lang"] for r in got] == ["a"] * 25 + ["b"] * 40


def test_probabilities(spark):
    df = lines(spark, {"a": 90, "b": 10})
    p = {r["lang"]: r["p"] for r in sample.lang_probs(df, 0.5).collect()}
    assert abs(p["a"] - math.sqrt(.9) / (math.sqrt(.9) + math.sqrt(.1))) < 1e-9 and abs(sum(p.values()) - 1) < 1e-9
    assert {r["p"] for r in sample.lang_probs(df, 0).collect()} == {0.5}


def test_shards_are_contiguous_and_cover(spark):
    got = sample.shard(lines(spark, {"a": 10, "b": 2}), 4).orderBy("lang", "idx").collect()
    assert [r["shard_id"] for r in got if r["lang"] == "a"] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r["shard_id"] for r in got if r["lang"] == "b"] == [0, 1]
    stats = {(r["lang"], r["shard_id"]): r["n"] for r in sample.lang_stats(sample.shard(lines(spark, {"a": 10, "b": 2}), 4)).collect()}
    assert stats["total", -1] == 12 and stats["a", -1] == 10 and stats["total", 0] == 4 and stats["a", 3] == 1


def test_batches_use_each_line_once_and_one_language(spark):
    sizes = {"a": 333, "b": 40, "c": 1}
    plan = sample.batch_plan(lines(spark, sizes), 16, 1.0, 3).collect()
    assert len({(r["lang"], r["row_id"], r["line_no"]) for r in plan}) == len(plan) == sum(sizes.values())
    by_batch = defaultdict(list)
    for r in plan:
        by_batch[r["batch_id"]].append(r)
    assert sorted(by_batch) == list(range(1, sum(math.ceil(n / 16) for n in sizes.values()) + 1))
    for rows in by_batch.values():
        assert len({r["lang"] for r in rows}) == 1
        assert sorted(r["batch_pos"] for r in rows) == list(range(len(rows))) and len(rows) <= 16


def test_bootstrap_counts_and_membership(spark):
    df = lines(spark, {"a": 50, "b": 300})
    got = sample.bootstrap(df, 8).collect()
    assert Counter(r["lang"] for r in got) == {"a": 50, "b": 300}
    order = sorted(range(300), key=lambda i: (md5(1, i // 3), i // 3, i % 3))
    h = int(md5(8, "b", 1)[:15], 16) % 300
    first = next(r for r in got if r["lang"] == "b" and r["draw"] == 1)
    assert first["line"] == f"line {order[h]}"


def test_bootstrap_has_no_cap(spark):
    df = spark.range(12_500).selectExpr("'a' as lang", "id as row_id", "0L as line_no", "cast(id as string) as line", "md5(cast(id as string)) as digest")
    got = sample.bootstrap(df, 8)
    assert got.count() == 12_500 and got.select("draw").distinct().count() == 12_500


def test_empty_input(spark):
    empty = lines(spark, {})
    assert sample.bootstrap(empty, 1).count() == 0 and sample.batch_plan(empty, 4).count() == 0


def test_lookup_join_beyond_the_broadcast_limit(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "id long, k string")
    table = df.select("k").distinct().where("k <> 'k0'").withColumn("v", F.length("k"))
    key = lambda r: (r["id"], r["k"], r["v"])
    small = sorted(map(key, lookup_join(df, table, ["k"]).collect()), key=str)
    apart = sorted(map(key, lookup_join(df, table, ["k"], limit=0).collect()), key=str)
    assert small == apart and len(small) == 200
    inner = lookup_join(df, table, ["k"], "inner", limit=0).collect()
    assert sorted(map(key, inner), key=str) == [r for r in small if r[2] is not None]


def test_filters(spark):
    def line(n):
        return " ".join(["w"] * n)
    rows = [("a", i, 0, line(i)) for i in (0, 1, 4, 5, 6, 255, 256)] + [("a", 999, 0, "  ")]
    df = spark.createDataFrame(rows, "lang string, row_id long, line_no long, line string")
    assert sorted(r["row_id"] for r in clean.min_words(df, 5).collect()) == [6, 255, 256]
    assert sorted(r["row_id"] for r in clean.len_window(df, 5, 256).collect()) == [5, 6, 255]
    assert sorted(r["row_id"] for r in clean.len_window(df, 1, 3).collect()) == [1]
    assert sorted(r["row_id"] for r in clean.min_words(df, 0).collect()) == [1, 4, 5, 6, 255, 256]


def test_sentences_follow_python(spark):
    texts = ["  a b \n\n c d\r\ne\x0bf\x1cg ", "　x y　", "one"]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts)], "lang string, row_id long, input string")
    got = defaultdict(list)
    for r in clean.to_sentences(df).orderBy("row_id", "line_no").collect():
        got[r["row_id"]].append(r["line"])
    assert got == {i: [x.strip() for x in t.strip().splitlines()] for i, t in enumerate(texts)}


def test_words_split_on_every_python_space(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = [f"{c}a{c}{c}b {c}c{c}" for c in spaces] + ["", " \u3000 ", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: (r["w"], r["n"]) for r in df.select("i", words(F.col("t")).alias("w"), word_count(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.split() or [""], len(t.split()))


def test_cleaning_and_labels(spark):
    df = spark.createDataFrame([("t", "World"), (" ", "world"), (None, "x"), ("u", None)], "news_title string, label string")
    assert [r["label_id"] for r in clean.encode_labels(clean.drop_missing(df), ["africa", "world"]).collect()] == [1]
    with pytest.raises(Exception, match="unknown label: World|unknown label: world"):
        clean.encode_labels(clean.drop_missing(df), ["africa"]).collect()
    dup = spark.createDataFrame([("a", 3, "x"), ("a", 1, "x"), ("b", 2, "x")], "lang string, row_id long, input string")
    assert sorted(map(tuple, clean.dedup(dup).collect())) == [("a", 1, "x"), ("b", 2, "x")]


def test_hold_out_does_not_depend_on_file_splits(spark, tmp_path):
    from tongueloom.sources import readers, sinks

    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'b', 'a') as lang", "id as row_id", "concat('sentence ', id, repeat(' x', 40)) as input")
    sinks.write_corpus(df.repartition(3, "row_id"), str(tmp_path / "mono"))
    held = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("20k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.read_corpus(spark, str(tmp_path / "mono"))
        held.append({(r.lang, r.row_id, r.input) for r in sample.split(rows, 0.2, 7).where("split = 'eval'").select("lang", "row_id", "input").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert held[0] == held[1] and len(held[0]) == 1200
