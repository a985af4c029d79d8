"""Search in M-trees against all products."""

import random

import numpy as np
import pytest

from statloom.llm import mtree


def brute(rows, queries, k, scale=1024):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    def whole(v):
        return tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)

    known = {(i, whole(v)) for i, v in rows if i is not None and usable(v)}
    out = []
    for q, v in {(i, whole(v)) for i, v in queries if i is not None and usable(v)}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("plan", [mtree.SearchPlan(), mtree.SearchPlan(k=3, tree=60, page=4, fan=3, block=7)])
def test_search_equals_all_products(spark, plan):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(n, [c + rng.gauss(0, .1) for c in rng.choice(centers)]) for n in range(400)]
    rows += [(n, [0.5, 0.25, -1.0, 0.0, 0.125, 2.0]) for n in range(400, 460)]  # one very common vector
    rows += [(460, None), (461, [1.0, None, 0.0]), (462, [float("nan")] * 6), (463, [float("inf")] * 6), (None, [1.0] * 6), (5, rows[5][1]),
             (6, [3.0] * 6), (464, [1.0, 2.0]), (465, [2.0, 1.0]), (466, []), (467, [1e6] * 6)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0] + [(6, [3.0] * 6)]
    asked = spark.createDataFrame(queries, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, mtree.search(vectors, asked, plan).collect()))
    assert got == brute(rows, queries, plan.k)
    assert mtree.search(vectors.limit(0), asked, plan).count() == 0 and mtree.search(vectors, asked.limit(0), plan).count() == 0


def test_bounds_save_products():
    rng = np.random.default_rng(9)
    centers = rng.integers(-40_000, 40_000, (40, 8))
    vectors = np.concatenate([c + rng.integers(-300, 300, (100, 8)) for c in centers])
    tree = mtree.Tree(mtree.build_pages(vectors, [[n] for n in range(len(vectors))], mtree.SearchPlan(page=32, fan=12)), 8)
    spent = 0
    for n in range(0, len(vectors), 200):
        found, computed = tree.search(vectors[n], n, 10)
        scores = vectors @ vectors[n]
        scores[n] = -2**62
        assert [s for s, _ in found] == sorted(scores.tolist(), reverse=True)[:10]
        spent += computed
    assert spent < 0.35 * 20 * len(vectors)
