"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tongueloom.llm.queries import QUERIES
from tongueloom.llm.spelling import Variants, blocks, nearest, roots, search, spelling_groups

SF = "/root/testdata/sf0.001"


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute_near(counts):
    return {w: [v for v in counts if one_error(w, v)] for w in counts}


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    counts = counted(rows)
    out = {}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_error(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best is not None and counts[best] >= 2 * n else None, n, len(near))

    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w

    return sorted((w, f, root(w), n, near, None if f is None else counts[f]) for w, (f, n, near) in out.items())


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def words(seed, letters, n, low=1, high=7):
    rnd = random.Random(seed)
    return list({"".join(rnd.choices(letters, k=rnd.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_one_block_finds_every_pair_once(letters):
    for seed in range(6):
        own = words(seed, letters, 60)
        counts = {w: 1 + i % 4 for i, w in enumerate(own)}
        want = {w: len(v) for w, v in brute_near(counts).items() if v}
        got = Counter()
        for size in range(0, 8):
            for low, high in ((0, size),) if seed % 2 else ((0, size // 2), (size // 2, size)):
                keyed = {}
                for w in own:
                    if len(w) in (size, size + 1):
                        keyed.setdefault((w[:low], w[len(w) - size + high:]), []).append(w)
                for block in keyed.values():
                    for w, n, _, _ in search(block, [counts[v] for v in block], size, low, high):
                        got[w] += n
        assert got == want


@pytest.mark.parametrize("block", [3, 40, 8192])
def test_blocks_of_any_size_give_the_same(spark, block):
    own = {w: 1 + i % 9 for i, w in enumerate(words(block, "abc", 500, 3, 8))}
    vocab = spark.createDataFrame(list(own.items()), "word string, n long")
    near = brute_near(own)
    want = {w: (len(v), min((-own[x], x) for x in v)) for w, v in near.items() if v}
    p = Variants(block=block)
    assert {r.word: (r.n_near, (-r.best_n, r.best)) for r in nearest(vocab, p).collect()} == want
    widest = blocks(vocab, p).where("high - low > 1").groupBy("size", "low", "high", "outside").count().agg({"count": "max"}).first()[0]
    assert widest is None or widest <= block


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}


def test_rows_with_nulls_ties_and_odd_letters(spark, docs_of):
    rnd = random.Random(3)
    pool = ["Colour", "COLOR", "colours", "Ähnlich", "ähnlich", "ÄHNLICH", "naïve", "naive", "x÷y×zab", "x" * 30_000, "abc", "straße", "strasse", "color1color"]
    rows = [(i, " ".join(rnd.choices(pool[:9] + pool[10:], k=400))) for i in range(30)] + [(40 + i, pool[9]) for i in range(3)]
    rows += [(None, "colour colors " * 5), (99, None), (98, ""), (97, "É" * 7 + " " + "é" * 7), (1, rows[1][1]), (1, "another text of colours")]
    df = docs_of(rows).selectExpr("*", "1 as word", "2 as n", "3 as size", "4 as low")
    assert result(spelling_groups(df)) == brute(rows)
    assert spelling_groups(docs_of([])).count() == 0
    assert spelling_groups(docs_of([(1, None), (2, "to be")])).count() == 0


def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op12_spelling"](spark, SF)) == brute(rows)
