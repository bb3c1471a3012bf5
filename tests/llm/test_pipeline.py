"""The pipeline's stages one by one on planted rows, and its run over the smallest tables."""

import random

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from compare import check, duck
from tongueloom.llm import oracles, queries
from tongueloom.llm.queries import TOKENIZERS  # noqa: F401

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(12)
    passage, base = words(rnd, 60), words(rnd, 200)
    near = base.split()
    near[50] = near[150] = "changed"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = {
        9001: f"{words(rnd, 80)}\n{passage}\n{words(rnd, 40)}", 9002: f"{words(rnd, 30)}\n{passage.upper()}\n{words(rnd, 90)}",
        9003: base, 9004: " ".join(near), 9005: f"{words(rnd, 100)}. {item} {words(rnd, 100)}", 9006: words(rnd, 120), 9007: None, 9008: "",
        9010: f"{base}\nand copies", 9011: f"{passage}",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, rows, passage, item


def run(stage, spark, docs):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    if stage != "sentencepiece":
        assert out.columns == COLUMNS
    return {r.doc_id: r for r in out.collect()}


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]


def test_toxicity_keeps_clean_documents(spark, planted):
    docs, rows, *_ = planted
    got = run("toxicity", spark, docs)
    assert set(got) == set(rows) and all(got[i].text == t for i, t in rows.items())


def test_line_dedup(spark, planted):
    docs, rows, passage, _ = planted
    got = run("line_dedup", spark, docs)
    assert got[9001].text == rows[9001] and passage.upper() not in got[9002].text and got[9002].text.count("\n") == 1
    assert got[9010].text == "and copies" and 9011 not in got and got[9007].text is None and got[9008].text == ""
    assert got[9002].n_chars == len(got[9002].text) and got[9006].text == rows[9006]


def test_near_dedup(spark, planted):
    docs, rows, *_ = planted
    got = run("near_dedup", spark, docs)
    assert set(rows) - set(got) == {9004, 9010} and all(got[i].text == rows[i] for i in got)


def test_decontaminate(spark, planted):
    docs, rows, _, item = planted
    got = run("decontaminate", spark, docs)
    assert item not in got[9005].text and len(got[9005].text.split()) == 201 and set(got) == set(rows)
    assert all(got[i].text == rows[i] for i in got if i != 9005)


def test_sentencepiece(spark, planted):
    docs, rows, *_ = planted
    got = run("sentencepiece", spark, docs)
    assert {i: r.text for i, r in got.items()} == rows and got[9006].n_pieces == len(got[9006].ids)


def test_whole_run_and_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * n < out.count() < n and out.count() == out.select("doc_id").distinct().count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        empty = spark.createDataFrame(fn(spark, empty, SF).collect(), fn(spark, empty, SF).schema)
        assert empty.count() == 0


def test_rows_that_repeat_an_id_or_have_none(spark, planted):
    docs, rows, passage, item = planted
    rnd = random.Random(5)
    own, more = words(rnd, 90), words(rnd, 70)
    extra = [(9005, own), (9005, f"{words(rnd, 60)} {item} {words(rnd, 60)}"), (None, f"{more} {item} {words(rnd, 70)}"), (9003, more), (9003, None)]
    mixed = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], docs.schema))
    for name, fn in corpus_pipeline.STAGES[1:]:
        mixed = spark.createDataFrame(fn(spark, mixed, SF).collect(), fn(spark, mixed, SF).schema)
    texts = [r.text for r in mixed.collect()]
    assert own in texts and more in texts and not any(item in t for t in texts if t) and sum(r.doc_id is None for r in mixed.collect()) == 1


def test_queries_are_registered_and_match_their_sql(spark):
    known = entry_points.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in known
    assert set(queries.QUERIES) <= set(known) and corpus_pipeline.ORACLE_SQL is None
    con = duck(SF)
    for name, sql in oracles.build().items():
        assert check(spark, con, SF, name, known[name], sql).startswith("ok")
