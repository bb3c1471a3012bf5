"""Line dedup against brute force over all runs of words, and over all runs of whole lines."""

import random

import pytest

import __spark_entry__ as entry_points
from tongueloom.llm.lines import LineDedup, dedup_lines

SF = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().lower().split()


def gone_words(rows, min_words):
    """Per row, which words lie in a window that occurred before."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words_of(t)
        out[i] = set()
        for a in range(len(w) - min_words + 1):
            if first.setdefault(tuple(w[a:a + min_words]), (i, a)) != (i, a):
                out[i] |= set(range(a, a + min_words))
    return out


def left_of(text, gone):
    """The words that stay, line by line, without the lines that have none left; blank lines are not told."""
    lines, at = [], 0
    for line in (text or "").split("\n"):
        own = line.encode().split()
        stay = [x for k, x in enumerate(own, at) if k not in gone]
        at += len(own)
        if stay:
            lines.append(stay)
    return lines


def brute(rows, min_words):
    """A line goes if some run of whole lines around it has enough words and starts at an earlier position too."""
    tables = {i: [(k, tuple(x.encode().lower().split())) for k, x in enumerate((t or "").split("\n")) if x.encode().split()] for i, t in rows}
    first = {}
    for i in sorted(tables):
        t = tables[i]
        for a in range(len(t)):
            for b in range(a, len(t)):
                run = tuple(w for _, w in t[a:b + 1])
                if sum(map(len, run)) >= min_words:
                    first.setdefault(run, (i, t[a][0]))
    out = {}
    for i, t in tables.items():
        gone = set()
        for a in range(len(t)):
            for b in range(a, len(t)):
                run = tuple(w for _, w in t[a:b + 1])
                if sum(map(len, run)) >= min_words and first[run] != (i, t[a][0]):
                    gone |= set(range(t[a][0], t[b][0] + 1))
        out[i] = gone
    return out


def run(df, p=LineDedup()):
    return {r.doc_id: (r.text, set(r.removed), r.n_lines) for r in dedup_lines(df, p).collect()}


def test_against_all_runs(docs_of):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(14)] + ["", "  "]
    rows = []
    for i in range(40):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(1, 12))]
        if i % 3 == 0 and rows:
            src = (rnd.choice(rows)[1] or "").split("\n")
            at = rnd.randrange(len(src))
            lines[2:2] = [x.upper() for x in src[at:at + 6]]
        rows.append((i, "\n".join(lines)))
    got, want = run(docs_of(rows), LineDedup(min_words=12)), brute(rows, 12)
    for i, t in rows:
        assert got[i][1] >= want[i], i  # all runs of whole lines, and passages that end inside lines
    gone = gone_words(rows, 12)
    for i, t in rows:
        assert left_of(got[i][0], ()) == left_of(t, gone[i]), i


def test_passages_inside_lines(docs_of):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 3)):
            src = rnd.choice(rows)[1].split() if rows else w
            a = rnd.randrange(len(src) + 1)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = src[a:a + rnd.randint(5, 40)]
        rows.append((i, "".join(x + rnd.choice([" ", " ", " ", "\n", "  ", "\n\n"]) for x in w)))
    for gram in (1, 4, 20):
        out = dedup_lines(docs_of(rows), LineDedup(min_words=15, gram=gram)).collect()
        gone = gone_words(rows, 15)
        assert sum(map(len, gone.values())) > 500
        text = dict(rows)
        for r in out:
            assert left_of(r.text, ()) == left_of(text[r.doc_id], gone[r.doc_id]) and r.n_cut == len(gone[r.doc_id])
    one = docs_of([(1, " ".join(vocabulary[:60])), (2, "Before it  " + " ".join(vocabulary[:60]) + " and  after it")])
    assert [r.text for r in dedup_lines(one).orderBy("doc_id").collect()] == [" ".join(vocabulary[:60]), "Before it  and  after it"]


@pytest.mark.parametrize("times", [1, 30])
def test_a_period_stays_once(docs_of, times):
    got = dedup_lines(docs_of([(1, "ha " * 50 * times)])).first()
    assert got.text.split() == ["ha"] * (50 if times == 1 else 1)


def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    gone, text = gone_words(rows, 50), dict(rows)
    got = entry_points.queries()["op3_winnowing"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_cut == len(gone[r.doc_id]) and left_of(r.text, ()) == left_of(text[r.doc_id], gone[r.doc_id])


def test_nulls_empty_long_and_extra_columns(docs_of):
    para = " ".join(f"w{k}" for k in range(60))
    df = docs_of([(1, None), (2, ""), (3, f"x\n{para}\nshort"), (4, f"short\n{para.upper()}"), (None, para), (5, (para + "\n") * 500)])
    got = {r.doc_id: r for r in dedup_lines(df.selectExpr("*", "9 as mark", "8 as spans", "7 as lo", "6 as removed")).collect()}
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[None].text == ""
    assert got[3].text == f"x\n{para}\nshort" and got[4].text == "short" and got[4].removed == [1]
    assert got[5].text == "" and got[5].n_lines == 501 and got[4].mark == 9 and got[4].spans == 8
    assert dedup_lines(docs_of([])).count() == 0


def test_rows_that_repeat_an_id_keep_their_own_lines(docs_of):
    para, other = (" ".join(f"{c}{k}" for k in range(55)) for c in "vw")
    rows = [(1, para), (2, f"own\n{para}\nlast"), (2, f"unlike\nsecond\n{other}"), (2, f"own\n{para}\nlast"), (None, f"{other}\nno id"), (None, "short")]
    want = sorted([(1, para), (2, "own\nlast"), (2, f"unlike\nsecond\n{other}"), (2, "own\nlast"), (None, "no id"), (None, "short")], key=str)
    for order in (rows, rows[::-1]):
        got = dedup_lines(docs_of(order).selectExpr("*", "1 as own_row", "2 as OWN_ID", "3 as gone_spans")).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want


def test_blocks_of_their_own_words_are_not_compared(docs_of, monkeypatch):
    """Only windows next to a repeated run are compared one by one, and no short window is lost with its block."""
    from tongueloom.llm import lines

    held, plain = {}, lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name: held.setdefault(name, plain(df, name)))
    rnd = random.Random(8)
    fresh = iter(range(100_000))
    own = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passage = own(55)
    rows = [(i, " ".join(own(40) + passage[rnd.randint(0, 2):] + own(40))) for i in range(20)]
    got, want = run(docs_of(rows)), gone_words(rows, 50)
    assert held["windows"].count() < 20 * 41 / 2  # of up to 41 windows a fingerprint, those near the passage
    for i, t in rows:
        assert [x.encode().split() for x in got[i][0].split("\n") if x.split()] == left_of(t, want[i])
    for least in (1, 2, 7, 9, 17):
        held.clear()
        few = [(i, " ".join(rnd.choices("abcde", k=rnd.randint(0, 30)))) for i in range(30)]
        got, want = run(docs_of(few), LineDedup(min_words=least, gram=4)), gone_words(few, least)
        for i, t in few:
            assert [x.encode().split() for x in got[i][0].split("\n") if x.split()] == left_of(t, want[i])


def test_blocks_do_not_move_to_be_compared_by_their_words(docs_of, spark, monkeypatch):
    """A filter of bounded size stands for the table of shared words, however large; what moves is the same with small tables and large ones."""
    import contextlib
    import io

    from tongueloom.llm import common, lines

    plans, plain = {}, lines.stage

    def staged(df, name):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans[name] = out.getvalue()
        return plain(df, name)

    monkeypatch.setattr(lines, "stage", staged)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("abcde", k=rnd.randint(0, 60)))) for i in range(30)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (0, 100_000):
            monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
            got, want = run(docs_of(rows), LineDedup(min_words=9, gram=4)), gone_words(rows, 9)
            assert "SortMergeJoin" not in plans["windows"] and "SortMergeJoin" in plans["told"]
            for i, t in rows:
                assert [x.encode().split() for x in got[i][0].split("\n") if x.split()] == left_of(t, want[i])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
