import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tongueloom.config import WORD_MARK
from tongueloom.operators import merges, subword
from tongueloom.operators.merges import MergePlan


def merge_once(syms, a, b):
    out, i = [], 0
    while i < len(syms):
        if i + 1 < len(syms) and (syms[i], syms[i + 1]) == (a, b):
            out.append(a + b)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def slow_bpe(counts, n):
    state = {w: [WORD_MARK, *w] for w in counts}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, s in state.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((a, b))
        state = {w: merge_once(s, a, b) for w, s in state.items()}
    return merges, state


def words(seed, letters, n=60, longest=7):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.randint(1, 30) for _ in range(n)}


@pytest.mark.parametrize("seed,letters,plan", [
    (1, "ab", MergePlan(candidates=4, sample=0)), (2, "abcde", MergePlan(sample=30, logs=1, bucket=20)), (3, "abcdéñ", MergePlan(ahead=3)), (4, "a", MergePlan())])
def test_training_equals_one_merge_at_a_time(spark, seed, letters, plan):
    counts = words(seed, letters)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want, state = slow_bpe(counts, 14)
    got, table = subword.train_bpe(df, 14, plan=plan)
    assert got == want
    assert {r["word"]: r["pieces"] for r in table.collect()} == state


def test_a_thousand_merges_equal_one_at_a_time(spark):
    counts = words(9, "abcdefgh", 2500, 9)
    want, state = slow_bpe(counts, 1000)
    got, table = subword.train_bpe(spark.createDataFrame(list(counts.items()), "word string, n long"), 1000)
    assert len(want) == 1000 and got == want
    assert {r["word"]: r["pieces"] for r in table.collect()} == state


def test_only_words_with_a_merged_pair_are_touched(spark):
    counts = {"abab": 50, "ab": 9, "xyxy": 40, "zz": 1}
    df = subword.with_symbols(spark.createDataFrame(list(counts.items()), "word string, n long"))
    index = merges.PairIndex(spark, df, None, MergePlan(logs=2))
    run = [("a", "b"), ("ab", "ab")]
    held = index.holders(run)
    assert {r["word"] for r in held.collect()} == {"abab", "ab"}
    index.log(held, run)
    assert {r["word"]: r["sym"] for r in index.holders([(WORD_MARK, "abab"), (WORD_MARK, "ab")]).collect()} == {
        "abab": f" {WORD_MARK}  abab ", "ab": f" {WORD_MARK}  ab "}
    assert index.holders([("a", "b"), ("ab", "ab"), ("b", "a")]).count() == 0
    index.log(index.holders([("x", "y")]), [("x", "y")])  # the second log writes the base anew
    assert not index.logs and {r["word"] for r in index.holders([("xy", "xy"), ("z", "z")]).collect()} == {"xyxy", "zz"}


def test_a_wrong_plan_is_cut_at_its_first_wrong_step(spark):
    totals = spark.createDataFrame([("a", "b", 9), ("c", "d", 7), ("e", "f", 7), ("b", "c", 6)], "left string, right string, n long")
    changes = spark.createDataFrame([(0, "a", "b", -9), (0, "b", "c", -2), (1, "e", "f", -7)], "step int, left string, right string, change long")
    assert merges.first_wrong(totals, changes, [("a", "b"), ("e", "f"), ("c", "d")], [9, 7, 7]) == 1  # c d comes first among equals
    changes = spark.createDataFrame([(0, "a", "b", -9), (0, "b", "c", 1), (1, "c", "d", -7)], "step int, left string, right string, change long")
    assert merges.first_wrong(totals, changes, [("a", "b"), ("b", "c")], [9, 7]) == 2
    assert merges.first_wrong(totals, changes, [("a", "b"), ("c", "d")], [9, 7]) == 1


def test_a_pair_may_be_merged_twice():
    assert merges.replay(["a", "b", "x"], merges.places([("a", "b"), ("ab", "x")]), None)[0] == ["abx"]
    twice = [("b", "c"), ("a", "bc"), ("d", "e"), ("b", "c")]
    assert subword.segmenter(twice)("abcbc") == [WORD_MARK, "abc", "bc"]
    assert merges.next_step(merges.places(twice), ("b", "c"), 0) == 3 and merges.next_step(merges.places(twice), ("b", "c"), 3) is None


def test_segmenter_equals_replaying_the_merges():
    counts = words(5, "abc", n=80)
    learned, _ = slow_bpe(counts, 25)
    segment = subword.segmenter(learned)
    for w in [*counts, "aaaaaaa", "cabcabcab", "x", "", "abx" * 200]:
        syms = [WORD_MARK, *w]
        for a, b in learned:
            syms = merge_once(syms, a, b)
        assert segment(w) == syms
        assert "".join(segment(w)) == WORD_MARK + w


def test_allowed_alphabet_keeps_rare_letters_apart(spark):
    df = spark.createDataFrame([("zz", 50), ("ab", 20)], "word string, n long")
    got, _ = subword.train_bpe(df, 2, allowed={WORD_MARK, "a", "b"}, plan=MergePlan(candidates=1))
    assert got == [("a", "b"), (WORD_MARK, "ab")]


def test_alphabet_stops_at_coverage(spark):
    df = spark.createDataFrame([("aaaa", 100), ("b", 1)], "word string, n long")
    assert [r["ch"] for r in subword.alphabet(df, 0.99).orderBy("rk").collect()] == ["a", WORD_MARK]


def test_encode_and_pad(spark):
    pairs = [("a", "b")]
    vocab = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "ab": 4, WORD_MARK: 5, "a": 6}
    df = spark.createDataFrame([("x", 1, 0, "ab a"), ("x", 2, 0, "abz"), ("y", 3, 0, "a a a a")],
                               "lang string, row_id long, line_no long, line string")
    enc = subword.encode_sequences(df, pairs, vocab, 7)
    assert {(r["row_id"], r["chunk_no"]): r["input_ids"] for r in enc.collect()} == {
        (1, 0): [0, 5, 4, 5, 6, 2], (2, 0): [0, 5, 4, 3, 2], (3, 0): [0, 5, 6, 5, 6, 5, 2], (3, 1): [0, 6, 5, 6, 2]}
    long = df.selectExpr("lang", "row_id", "line_no", "repeat('ab a ', 9) as line")  # five times the length and more
    rows = subword.encode_sequences(long, pairs, vocab, 7).where("row_id = 1").orderBy("chunk_no").collect()
    assert [i for r in rows for i in r["input_ids"][1:-1]] == [5, 4, 5, 6] * 9 and max(len(r["input_ids"]) for r in rows) == 7
    longest = {(r["row_id"], r["chunk_no"]): (r["input_ids"], r["attention_mask"]) for r in subword.pad_sequences(enc).collect()}
    assert longest[2, 0] == ([0, 5, 4, 3, 2, 1], [1, 1, 1, 1, 1, 0]) and len(longest[3, 1][0]) == 7
    fixed = subword.pad_sequences(enc, "max_length", 9).select(F.size("input_ids").alias("n")).distinct().collect()
    assert [r["n"] for r in fixed] == [9]


@pytest.mark.parametrize("more", [0, 2000])
def test_dictionary_join_gives_the_same_rows(spark, more):
    pairs = [("a", "b"), (WORD_MARK, "ab"), ("c", "c")]
    vocab = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "ab": 4, WORD_MARK: 5, "a": 6, "b": 7, WORD_MARK + "ab": 8, **{f"x{i}": 9 + i for i in range(more)}}
    lines = ["ab a", "", "  ", "abz ab ab", "cc ab\u00a0b", "ab a " * 40, "hot " * 30]
    df = spark.createDataFrame([("x", i, 0, t) for i, t in enumerate(lines)], "lang string, row_id long, line_no long, line string")
    rows = lambda e: sorted((r["row_id"], r["chunk_no"], r["input_ids"]) for r in e.collect())
    assert rows(subword.encode_by_dictionary(df, pairs, vocab, 9)) == rows(subword.encode_sequences(df, pairs, vocab, 9))


def test_vocab_has_no_piece_twice(spark):
    letters = spark.createDataFrame([("a", 5, 1), ("b", 4, 2)], "ch string, n long, rk long")
    rows = subword.vocab_table(spark, [("a", "b"), ("ab", "c"), ("a", "bc")], letters).orderBy("id").collect()
    assert [r["piece"] for r in rows] == ["<s>", "<pad>", "</s>", "<unk>", "ab", "abc", "a", "b", "<mask>"]
    assert [r["id"] for r in rows] == list(range(9))


def test_frequent_merges_need_few_parts_of_the_words(spark, monkeypatch):
    rng = random.Random(3)
    counts = {rng.choice(("the", "and", "ring")) + "".join(rng.choice("qxzjkvwpbmfy") for _ in range(5)) + rng.choice(("ing", "the", "")): 1 for _ in range(800)}
    entered = []
    whole = merges.PairIndex.__init__
    monkeypatch.setattr(merges.PairIndex, "__init__", lambda self, spark, words, *more: entered.append(words.count()) or whole(self, spark, words, *more))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert subword.train_bpe(df, 6)[0] == slow_bpe(counts, 6)[0]
    assert sum(entered) < len(counts) // 4
    monkeypatch.setattr(merges.Sample, "reach", lambda self, n: 400.0)  # too high a floor: the words are cut again, at lower ones
    assert subword.train_bpe(df, 9)[0] == slow_bpe(counts, 9)[0]


def test_cut_words_keep_every_pair_at_or_above_the_floor():
    assert list(merges.cut("_abcab", {"ab", "ca"})) == ["ab", "cab"]
    assert list(merges.cut("_a", {"ab"})) == [] and list(merges.cut("aab", {"aa", "ab"})) == ["aab"]


def test_words_are_encoded_by_their_few_parts():
    rng = random.Random(8)
    learned = [("a", "b"), ("ab", "c"), (WORD_MARK, "x"), ("b", "a"), ("c", "abc")]
    some = ["".join(rng.choice("abcxñ\U0001f600") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    of, segment, asked = subword.WordPieces(learned), subword.segmenter(learned), []
    part_of = of.segment
    of.segment = lambda part: asked.append(part) or part_of(part)
    n, flat = of(pa.array(some))
    want = [segment(w) for w in some]
    assert n.tolist() == [len(x) for x in want] and flat.to_pylist() == [p for x in want for p in x]
    assert len(asked) < len(set(some)) // 4
    assert [len(x) for x in of(pa.array([], type=pa.string()))] == [0, 0]
    assert subword.WordPieces([], {"a": 7})(pa.array(["ab", "a"]))[1].to_pylist() == [3, 7, 3, 3, 7]
