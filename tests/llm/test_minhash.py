"""MinHash near-duplicates against brute force over all pairs."""

import random

import pytest

from tongueloom.llm.minhash import MinHash, near_duplicates
from tongueloom.llm.queries import QUERIES


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def run(df, p=MinHash()):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, p).collect()}


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 9)):
            text = list(base)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(len(text))] = word()
            rows.append((n, " ".join(text) if n % 3 else "\t".join(text).upper()))
            n += 1
    return rows


def test_against_all_pairs(docs_of):
    rows = corpus()
    assert run(docs_of(rows)) == brute(rows)


def test_short_empty_null_and_copies(docs_of):
    rows = [(5, "One two"), (3, "one  TWO"), (8, "one two three"), (1, None), (2, ""), (4, " \n\t"), (7, "x" * 100_000), (6, "x" * 100_000),
            (9, "É É É"), (10, "é é é")]
    got = run(docs_of(rows))
    assert got == brute(rows)
    assert got[5] == (1, 3, False) and got[1] == (0, 1, True) and got[9][1] != got[10][1]


def test_empty_table_clashing_columns_and_repeated_rows(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    df = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 as component_id", "2 as bucket", "3 as n")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


@pytest.mark.parametrize("p", [MinHash(block=5, heads=1, rounds=1), MinHash(block=7, heads=2, rounds=2), MinHash(block=20)])
def test_large_families_in_small_blocks(docs_of, p):
    """Chains of ever larger changes: one family with links of all kinds, some of which only the last step compares."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows, base = [], [word() for _ in range(100)]
    for i in range(120):
        base[rnd.randrange(len(base))] = word()
        text = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            text[rnd.randrange(len(text))] = word()
        rows.append((1000 - i, " ".join(text)))
    assert run(docs_of(rows), p) == brute(rows)


def test_a_common_line_costs_no_blocks_of_pairs(docs_of, monkeypatch):
    """Sets that share a frequent line alone are not dealt to all blocks of their family; those that are similar are linked."""
    from tongueloom.llm import minhash

    dealt, plain = [], minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda df, p: (dealt.append(df.count()), plain(df, p))[1])
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    line = [word() for _ in range(40)]
    rows = [(i, " ".join(line + [word() for _ in range(30)])) for i in range(300)]
    rows += [(1000 + i, f"{t} {word()}") for i, t in rows[:40]] + [(2000 + i, " ".join([*line, word()])) for i in range(60)]
    p = MinHash(block=8, heads=2, rounds=1)
    assert run(docs_of(rows), p) == brute(rows)
    assert len(dealt) == 2 and dealt[-1] < 2 * len(rows)


def test_rows_that_repeat_an_id_with_other_texts(docs_of):
    a, b, c = "a b c d e f g h", "one two three four five six", "x y z"
    rows = [(2, a), (2, b), (1, b), (3, a), (2, c), (2, c), (None, a)]
    want = sorted([(2, 4, 2, True), (2, 2, 1, False), (1, 2, 1, True), (3, 4, 2, False), (2, 1, 2, True), (2, 1, 2, True), (None, 4, None, None)], key=str)
    for order in (rows, rows[::-1]):
        assert sorted((tuple(r)[:4] for r in near_duplicates(docs_of(order)).collect()), key=str) == want


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minhash"](spark, sf).collect()} == brute(rows)
