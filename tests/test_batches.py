"""Steps that run on whole Arrow batches give what the expressions they replace give, and read their input once."""

import contextlib
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tongueloom.config import BOS_ID, EOS_ID, IGNORE_LABEL_ID, PAD_ID
from tongueloom.functions.arrays import label_indices
from tongueloom.operators import lm, ner
from tongueloom.plans import views
from tongueloom.sources import readers, sinks


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_tags_of_batches_equal_the_expression(spark):
    rng = random.Random(5)
    pool = ["a", "é", "", "da", "ka", "🙂", *(f"w{i}" for i in range(40))]
    rows = [([rng.choice(pool) for _ in range(rng.randint(1, 12))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "w array<string>")
    by_batch = F.arrow_udf(views._tag_lists, "array<string>")("w")
    assert df.select("w", by_batch.alias("t"), views._tag_array(F.col("w")).alias("e")).where(~F.col("t").eqNullSafe(F.col("e"))).count() == 0


def test_tags_of_sentences_hash_no_word_in_a_lambda(spark):
    docs = spark.createDataFrame([("en", 1, "one two three four five six\nseven")], "lang string, row_id bigint, input string")
    assert "md5" not in plan_of(views.tagged_of(docs).select("guid", "labels"))


def test_mask_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(i if i % 5 else None, i % 3, 0, [BOS_ID, *(rng.randint(5, 90) for _ in range(rng.randint(0, 30))), EOS_ID, PAD_ID]) for i in range(120)]
    df = spark.createDataFrame([("en", *r) for r in rows], "lang string, row_id bigint, line_no bigint, chunk_no bigint, input_ids array<bigint>")
    masked = lm.mlm_mask(df, 100, 100, 0.5, 7)
    assert "md5" not in plan_of(masked)
    want = []
    for row_id, line_no, chunk_no, ids in rows:
        new, labels = [], []
        for i, x in enumerate(ids):
            key = "|".join(str(p) for p in (7, row_id, line_no, chunk_no, i) if p is not None)
            h = hashlib.md5(key.encode()).hexdigest()
            a, b, c = (int(h[k:k + 8], 16) / 2**32 for k in (0, 8, 16))
            hit = x not in (BOS_ID, PAD_ID, EOS_ID) and a < 0.5
            new.append((100 if b < 0.8 else int(c * 2**32) % 100 if b < 0.9 else x) if hit else x)
            labels.append(x if hit else IGNORE_LABEL_ID)
        want.append((row_id, line_no, chunk_no, new, labels))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[1:] for r in masked.collect()), key=key) == sorted(want, key=key)


def test_piece_counts_are_not_exploded(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 6) for _ in range(8)], [rng.choice([-100, 0, 1, 2]) for _ in range(8)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "input_ids array<bigint>, label_ids array<bigint>").repartition(3)
    got = ner.fit_piece_scores(df, 7, 3)
    for p in range(7):
        for t in range(3):
            assert got[p, t] == sum(x == p and y == t for ids, tags in rows for x, y in zip(ids, tags))
    with pytest.raises(Exception, match="outside the table"):
        ner.fit_piece_scores(df, 6, 3)
    assert ner.fit_piece_scores(df.limit(0), 7, 3).sum() == 0


def test_positions_without_a_label_are_not_scored(spark):
    rows = [("a", 1, [-100, 1], [[0.0, 9.0], [1.0, 1.0]]), ("a", 0, [0, -100], [[0.0, 2.0], [5.0, 0.0]]), ("b", 0, [-100], [[0.0, 1.0]])]
    df = spark.createDataFrame(rows, "guid string, chunk_no bigint, label_ids array<bigint>, scores array<array<double>>")
    got = {r.guid: (r.labels, r.pred) for r in ner.decoded(df, ["O", "B-X"]).collect()}
    assert got == {"a": (["O", "B-X"], ["B-X", "O"]), "b": ([], [])}


def test_an_unknown_or_missing_label_ends_the_job(spark):
    df = spark.createDataFrame([(["A", "B"],), ([],), (None,)], "t array<string>")
    at = label_indices(F.col("t"), ["B", "A"], "tag")
    assert [r[0] for r in df.select(at).collect()] == [[1, 0], [], None]
    for bad, told in (("C", "unknown tag: C"), (None, "unknown tag: null")):
        with pytest.raises(Exception, match=told):
            spark.createDataFrame([(["A", bad],)], "t array<string>").select(at).collect()


def slow_token_lines(row, text):
    h = lambda *parts: int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)
    out = ["-DOCSTART- O", ""] if row is not None and row % 100 == 0 else []
    for line in (x.strip() for x in text.strip().splitlines()):
        if len(line.split()) > 5:
            before = None
            for w in line.split():
                at = h(w) % 10
                kind = views.ENTITY_TYPES[at] if at < 4 else None
                tag = "O" if kind is None else f"I-{kind}" if kind == before else f"B-{kind}"
                out.append(w if h("n", *([] if row is None else [str(row)]), w) % 50 == 0 else f"{w} {tag}")
                before = kind
            out += ["", ""] if h("b", line) % 97 == 0 else [""]
    return out


def test_token_lines_are_made_once_and_written_in_order(spark, tmp_path):
    rng = random.Random(7)
    pool = ["a", "é", "🙂", *(f"w{i}" for i in range(60))]
    blanks, breaks = [" ", "  ", "\u3000", "\x1f", "\t"], ["\n", "\r\n", "\x85", "\n\n", "\u2028"]

    def text():
        line = lambda: "".join(rng.choice(pool) + rng.choice(blanks) for _ in range(rng.randint(1, 14)))
        return "".join(line() + rng.choice(breaks) for _ in range(rng.randint(0, 9)))

    rows = [(rng.choice(["en", "fr"]), i, text() if i % 9 else None) for i in range(1, 402)]
    rows += [("en", None, text() + "a b c d e f")]
    expected = [(lang, None if row is None else row * views.DOC_SHIFT + i, x) for lang, row, t in rows if t is not None for i, x in enumerate(slow_token_lines(row, t))]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "lang string, row_id bigint, input string")
    lines = views.conll_lines_of(docs.repartitionByRange(6, "lang", "row_id").mapInArrow(counted, docs.schema))
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    sinks.write_conll(lines, str(tmp_path / "out"), ranged=True)
    assert seen.value == len(rows)
    read = readers.read_conll(spark, str(tmp_path / "out/*"), r"/file=([^/]+)/")
    assert "regexp" not in plan_of(read).lower()  # the name is worked out once a block
    got = sorted(map(tuple, read.collect()))
    assert sorted(map(tuple, lines.collect()), key=key) == sorted(expected, key=key)
    for name in ("en", "fr"):
        own = [x for lang, _, x in sorted((e for e in expected if e[0] == name and e[1] is not None))]
        mine = [x for lang, _, x in got if lang == name]
        assert mine[len(mine) - len(own):] == own  # lines without a number come first
        assert [n for lang, n, _ in got if lang == name] == list(range(1, len(mine) + 1))
