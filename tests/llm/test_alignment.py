"""Alignment against the libraries on whole texts, and a plain count of overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tongueloom.llm.alignment import TokenPair, alignments, gallop, hottest, shown_bytes
from tongueloom.llm.queries import QUERIES, pairing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    p = pairing()
    a = Tokenizer.from_file(p.first)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=p.second)


def brute(rows, libraries):
    lib_a, lib_b = libraries
    letter = shown_bytes()
    docs = []
    for doc, text in rows:
        a = lib_a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        raw_a = [bytes(letter[c] for c in lib_a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(lib_b.id_to_piece(i)[3:-1], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            a = b = raw_a = raw_b = []
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for x in raw:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, k = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while k < len(b) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(b) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, pa, pb = [], 0, 0
        for cut in sorted(cuts):
            ga, gb = [], []
            while pa < len(a) and spans[0][pa][1] <= cut:
                ga.append(a[pa])
                pa += 1
            while pb < len(b) and spans[1][pb][1] <= cut:
                gb.append(b[pb])
                pb += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        docs.append((doc, a, b, links, groups))
    counts = Counter(pair for *_, links, _ in docs for pair in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, a, b, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_gallop_from_any_guess():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 5, 200):
        long = np.unique(rnd.integers(1, 5 * n + 2, n))
        values = np.sort(rnd.integers(0, long[-1] + 1, 300))
        for guess in (np.zeros(300, int), np.full(300, len(long) + 3), rnd.integers(-2, len(long) + 2, 300), np.searchsorted(long, values)):
            assert (gallop(values, long, guess) == np.searchsorted(long, values)).all()


ODD = ["word", " ", "  ", "\n", " \n ", "\t", "é", "日本", "🙂", "'s", "<s>", "<|endoftext|>", "<0x41>", "▁", "x" * 90, "1234", "\x00", "ß", "̈", " "]


def odd_rows():
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices(ODD, k=rnd.randint(0, 12)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " "), (203, "same text"), (204, "same text"), (203, "same text"), (203, "another text"), (None, "no id"),
                   (205, "long text of words " * 5000), (206, "w" * 20_000), (207, " leading"), (208, "trailing "), (209, "a  b")]


@pytest.mark.parametrize("more", [{}, {"hot": 20, "buffer": 30, "cache": 5}, {"hot": 0}])
def test_odd_texts_with_and_without_hot_pairs(docs_of, libraries, more):
    rows = odd_rows()
    df = docs_of(rows).selectExpr("*", "1 as pair", "2 as n", "3 as row", "4 as times").repartition(3)
    assert result(alignments(df, pairing(**more))) == brute(rows, libraries)


def test_empty_table(docs_of):
    assert alignments(docs_of([]), pairing()).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 5, 30, 1000])
def test_no_more_hot_pairs_than_allowed(spark, limit):
    rnd = random.Random(limit)
    n = [rnd.choice([1, 1, 2, 3, 9, 10, 100, 10**6]) for _ in range(60)]
    counts = spark.createDataFrame(list(enumerate(n)), "pair long, n long")
    least = hottest(counts, limit)
    assert sum(x >= least for x in n) <= limit


def test_words_in_a_row_equal_whole_texts(libraries):
    lib_a, lib_b = libraries
    pair = TokenPair(pairing())
    texts = [t for _, t in odd_rows() if t and "▁" not in t and "\x00" not in t]
    ids = pair.encode([t.encode() for t in texts])
    assert [np.frombuffer(a, dtype=np.int32).tolist() for a, _ in ids] == [lib_a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, dtype=np.int32).tolist() for _, b in ids] == [lib_b.encode(t) for t in texts]


def test_registered_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op13_gallop"](spark, SF)) == brute(rows, libraries)
