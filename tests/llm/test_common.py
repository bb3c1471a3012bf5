"""Connected components and the compact word memory against plain Python."""

import random

import numpy as np
import pytest

from tongueloom.llm.common import components, smallest_member
from tongueloom.llm.wordhash import Remembered, Words, grouped, keys, shingle_hashes


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["path", "star", "random", "odd"])
def test_components(spark, shape):
    rnd = random.Random(4)
    edges = {"path": [(k, k + 1) for k in range(400)], "star": [(500, k) for k in range(300)],
             "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)],
             "odd": [(1, 1), (None, 2), (3, None), (-5, 7), (7, -5), (7, -5)]}[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in smallest_member(components(df)).collect()} == brute(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_remembered():
    memory, truth, rng = Remembered(np.int32, merge_at=7), {}, np.random.default_rng(0)
    for _ in range(60):
        h = np.unique(rng.integers(0, 200, 15).astype(np.uint64))
        rows = memory.find(h)
        assert [r >= 0 for r in rows.tolist()] == [int(x) in truth for x in h]
        new = h[rows < 0]
        values = [rng.integers(0, 99, rng.integers(1, 4)) for _ in new]
        if len(new):
            memory.add(new, np.concatenate(values), np.array([len(v) for v in values]))
            truth.update({int(x): v.tolist() for x, v in zip(new, values)})
        flat, ends = memory.take(memory.find(h))
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [truth[int(x)] for x in h]
        if len(memory) > 100:
            memory.keep(h)
            truth = {int(x): truth[int(x)] for x in h}


def test_words_and_shingles():
    texts = [b"", b"one", b" a b  c\td\x0be f ", b"a b c d e f", "é é".encode()]
    w = Words(texts)
    assert np.diff(w.bounds).tolist() == [len(t.split()) for t in texts]
    sets = shingle_hashes(w.hashes, w.bounds, 5)
    assert [len(s) for s in sets] == [0, 1, 2, 2, 1] and (sets[2] == sets[3]).all()
    assert len(set(keys(1000, 3).tolist())) == 1000


def test_grouped_runs_cross_batches():
    import pyarrow as pa

    rows = [0, 0, 1, 1, 1, 2, 3, 3]
    batches = [pa.RecordBatch.from_pydict({"k": rows[a:b]}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 8))]
    assert [[v for b in g for v in b.column("k").to_pylist()] for g in grouped(batches, ("k",))] == [[0, 0], [1, 1, 1], [2], [3, 3]]
