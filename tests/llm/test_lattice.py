"""Lattice hashing against brute force over all pairs."""

import numpy as np

from tongueloom.llm.lattice import Lattice, nearest_e8, near_duplicates


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(rows, least=0.95):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    links = {i: {j for j in unit if i in unit and j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= least} for i, _ in rows}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def run(df, p=Lattice()):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, p).collect()}


def test_nearest_point_is_in_the_lattice_and_nearest():
    y = np.random.default_rng(0).normal(size=(500, 8)) * 2
    x = nearest_e8(y)
    assert ((x == np.rint(x)).all(1) | (x + 0.5 == np.rint(x + 0.5)).all(1)).all() and (x.sum(1) % 2 == 0).all()
    assert (((y - x) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius of E8 is 1


def test_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(30):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.normal(size=64) * 0.12).tolist()))
    many = rng.normal(size=64)
    rows += [(1000 + k, (many + rng.normal(size=64) * 0.05).tolist()) for k in range(90)]
    rows += [(2000 + k, rows[3][1]) for k in range(20)] + [(3000, [x * 3 for x in rows[3][1]])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 64), (4003, [None] + [1.0] * 63), (4004, [float("nan")] * 64), (4005, [float("inf")] + [1.0] * 63),
             (4006, [1.0, 2.0]), (4007, [2.0, 4.0])]
    want = brute(rows)
    assert run(vectors(spark, rows), Lattice(block=16)) == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.951
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = run(vectors(spark, rows))
    assert sum(n for n, _, _ in got.values()) >= 0.9 * 800


def test_empty_and_clashing_columns(spark):
    assert near_duplicates(vectors(spark, [])).count() == 0
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01])]).selectExpr("*", "1 as cell", "2 as own", "'x' as label", "3 as n_links")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 1)]
