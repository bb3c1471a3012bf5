"""Decontamination against brute force over all windows."""

import random
import re

from tongueloom.llm.decontaminate import Decontam, find_hits, remove_hits

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(rows, items, k):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - k + 1)) if w else ():
            wins.setdefault(tuple(w[a:a + k]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[tuple(w[a:a + n])]
        out[d] = (len(w), hit, sorted(found))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def spread(spans):
    return {k for s in spans for k in range(s.first, s.last + 1)}


def data():
    rnd = random.Random(3)
    say = lambda n, v="abcdef": " ".join(rnd.choice(v) for _ in range(n))
    items = [(i, say(rnd.choice([2, 3, 5, 8, 12, 20]))) for i in range(25)] + [(90, None), (91, " -- "), (92, "Ü x-Ü"), (3, say(9)), (93, "q")]
    rows = [(i, say(rnd.randint(0, 60))) for i in range(40)]
    for i in range(40, 70):
        t = rnd.choice(items)[1] or ""
        rows.append((i, f"{say(7)}. {t.upper()}, {say(6)}"))
    return rows + [(70, None), (71, ""), (72, "ü x ü q?"), (73, "zz " * 3000 + (items[4][1] or ""))], items


def test_against_all_windows(spark, docs_of):
    rows, items = data()
    for p in (Decontam(window=4), Decontam(window=4, block_bytes=60), Decontam(window=9)):
        want = brute(rows, items, p.window)
        got = {r.doc_id: r for r in find_hits(docs_of(rows).selectExpr("*", "1 as spans", "2 as items"), bench(spark, items), p).collect()}
        assert len(got) == len(rows)
        for i, (n, hit, found) in want.items():
            assert (got[i].n_words, spread(got[i].spans), got[i].items) == (n, hit, found), (p, i)


def test_removal(spark, docs_of):
    item = " ".join(f"w{k}" for k in range(14))
    rows = [(1, f"one two three before, {item.upper()}! after"), (2, f"{item} x"), (3, "clean ü"), (4, None), (None, item), (5, f"{item[3:]} " + "y " * 40)]
    got = {r.doc_id: r.text for r in remove_hits(docs_of(rows), bench(spark, [(1, item)])).collect()}
    assert got[1] == "one two three before, ! after"
    assert 2 not in got and got[3] == "clean ü" and got[4] is None and None not in got and "w5" not in got[5]


def test_empty_tables(spark, docs_of):
    assert find_hits(docs_of([]), bench(spark, [(1, "a b")])).count() == 0
    assert find_hits(docs_of([(1, "a b")]), bench(spark, [])).first().spans == []


def test_null_and_repeated_ids_over_many_blocks(spark, docs_of):
    rows, items = data()
    rows = [(None if i % 4 == 0 else 7 if i % 4 == 1 else i, t) for i, t in rows] + rows[40:44] * 3
    for blocks in (1_000_000, 60):
        p = Decontam(window=4, block_bytes=blocks)
        alone = [(i, brute([(0, t)], items, 4)[0]) for i, t in rows]
        want = [(i, n, sorted(hit), found) for i, (n, hit, found) in alone]
        got = [(r.doc_id, r.n_words, sorted(spread(r.spans)), r.items) for r in find_hits(docs_of(rows), bench(spark, items), p).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), blocks


def test_removal_goes_by_row(spark, docs_of):
    item = " ".join(f"w{k}" for k in range(12))
    long = "before " * 20 + item + " after" * 20
    rows = [(2, long), (2, "short"), (2, "three other words"), (None, long), (None, "clean"), (2, long)]
    df = docs_of(rows).selectExpr("*", "1 as row_key", "2 as hit_spans", "3 as Over_Limit")
    got = remove_hits(df, bench(spark, [(1, item)]))
    cut = "before " * 20 + " after" * 20
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, cut if t == long else t) for i, t in rows), key=str)
    assert got.columns == df.columns
