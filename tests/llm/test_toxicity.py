"""String-kernel toxicity: the kernel by brute force, held-out accuracy, gapped and changed insults."""

import random
import tracemalloc
from itertools import combinations

import numpy as np

from tongueloom.llm.common import crc_bucket
from tongueloom.llm.toxicity import _TABLE, CODES, Subsequences, Toxicity, _svm, fit, joined, reject, score


def kernel(a, b, p):
    def features(w):
        codes = [CODES - 1, *(int(_TABLE[ord(c)]) for c in w)]
        out, norm = {}, 0.0
        for i, j, k in combinations(range(len(codes)), 3):
            if k - i < p.span and codes[i] and codes[j] and codes[k]:
                weight = p.decay ** (k - i - 2)
                out[codes[i], codes[j], codes[k]] = out.get((codes[i], codes[j], codes[k]), 0) + weight
                norm += weight ** 2
        return {key: v / np.sqrt(norm) for key, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(key, 0) for key, v in x.items())


def test_kernel_is_that_of_all_subsequences():
    p = Toxicity()
    words = ["idiot", "id.i-ot", "ixdxixoxt", "worthless", "über", "a", "", "aaaa", "x" * 30]
    for b in words[:-1]:
        table = Subsequences([b.encode()], p).table(np.ones(1))
        got = Subsequences([w.encode() for w in words], p).against(table)
        assert np.allclose(got, [kernel(w, b, p) for w in words], atol=1e-5)


def corpus(n=1500, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rnd.randint(1, 4)))
    bad = lambda: rnd.choice(["idiot", "moron", "scum", "lowei" + word(), "vequ" + word()])
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rnd.randint(20, 80))], int(rnd.random() < 0.2)
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), bad())
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_changed_insults(spark, docs_of):
    rows, labels = corpus()
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(docs, lab)
    truth = {i: t for i, _, t in labels}
    held = [r for r in score(docs, model).join(docs.select("doc_id", crc_bucket("doc_id", 4).alias("b")), "doc_id").collect() if r.b == 2]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    clean = "the an on there ined hean the then in ther an on"
    odd = [(1, clean), (2, f"{clean} i d i o t {clean}"), (3, f"{clean} id-iot {clean}"), (4, f"{clean} m.o.r.o.n {clean}"), (5, f"{clean} IDIIOT {clean}"),
           (6, None), (7, ""), (None, f"{clean} idiot"), (8, (clean + " ") * 3000), (2, f"{clean} idiot")]
    got = [(r.doc_id, r.predicted) for r in score(docs_of(odd).selectExpr("*", "1 as score", "2 as toxic"), model).collect()]
    assert [p for _, p in got] == [0, 1, 1, 1, 1, 0, 0, 1, 0, 1]
    assert reject(docs_of(odd), model).count() == 4 and score(docs_of([]), model).count() == 0


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in score(docs_of([(1, "idiot")]), fit(docs_of([(1, "idiot")]), none)).collect()] == [0]
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 7)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in score(docs_of([(1, None)]), fit(docs_of([(1, "a")]), odd)).collect()] == [0]


def test_letters_set_apart():
    assert joined(b"x I D I O T y a b z") == b"xidioty a b z" or joined(b"xx I D I O T yy a b zz") == b"xx idiot yy a b zz"


def test_the_fit_holds_its_features_once():
    rng = np.random.default_rng(4)
    z = np.column_stack((rng.normal(size=(30_000, 40)), np.ones(30_000)))
    bad, good = rng.random(30_000) * (z[:, 0] > 0), rng.random(30_000)
    tracemalloc.start()
    w = _svm(z, bad, good, 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < z.nbytes / 2  # with every row twice and its active copies it was several times as much
    slope = 1e-3 * w - (bad * np.maximum(1 - z @ w, 0)) @ z + (good * np.maximum(1 + z @ w, 0)) @ z
    assert np.abs(slope[:-1]).max() < 1e-4
