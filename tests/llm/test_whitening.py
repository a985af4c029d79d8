"""Whitening against numpy's eigenvectors, and its steps by themselves against exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import whitening


def exact_polynomial(matrix):
    """By traces of powers (Faddeev and LeVerrier), the constant first."""
    d = len(matrix)
    m, out = [[0] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        trace = sum(matrix[i][l] * m[l][i] for i in range(d) for l in range(d))
        out.append(-Fraction(trace, k))
    return [int(c) for c in out[::-1]]


@pytest.mark.parametrize("kind", ["full", "rank", "blocks", "zero", "one"])
def test_polynomial(spark, kind):
    rng = np.random.default_rng(1)
    a = {"full": rng.integers(-900, 900, (30, 9)), "rank": rng.integers(-900, 900, (3, 9)),
         "blocks": np.kron(np.eye(3, dtype=int), rng.integers(-90, 90, (4, 3))), "zero": np.zeros((2, 4), int),
         "one": np.array([[7]])}[kind]
    matrix = [[int(v) for v in row] for row in a.T @ a]
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_roots_are_isolated_with_their_multiplicity():
    def product(roots):
        out = [1]
        for r in roots:
            out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
        return out

    roots = [0, 0, 5, 5, 5, 10**20, 10**20 + 1]
    got = whitening.largest_roots(product(roots), 7)
    assert [Fraction(a, 2**h) for a, h in got] == sorted(roots, reverse=True)
    a, h = whitening.largest_roots([2, -4, 1], 1)[0]  # 2 and the square root of 2
    assert abs((Fraction(a, 2**h) - 2) ** 2 - 2) < Fraction(1, 10**50)


def whole(rows):
    return np.array([[math.floor(1024 * float(np.float32(x))) + 100_000 for x in v] for _, v in rows], float)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12)) * np.geomspace(1, 0.05, 12)
    return [(n, [float(np.float32(x)) for x in rng.normal(size=12) @ mix]) for n in range(700)]


def test_equals_numpy(spark, vectors):
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("-inf")] * 12), (904, [])]
    df = spark.createDataFrame([(*r, 1.5) for r in vectors + bad], "vec_id long, embedding array<float>, whitened double").repartition(4)
    rows = whitening.whiten(df).collect()
    x = whole(vectors)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - x.mean(0)) @ axes[:, :8] / np.sqrt(values[:8])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == 700 * 8 and {r.n for r in rows} == {700}
    whitened = np.array([[got[i, c].whitened for c in range(1, 9)] for i, _ in vectors])
    signs = np.sign((whitened * want).sum(0))
    assert np.allclose(whitened * signs, want, atol=1e-8)
    assert np.allclose([got[0, c].explained for c in range(1, 9)], values[:8] / values.sum(), rtol=1e-12)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    whole_x = x.astype(int).astype(object)
    deviation = ((whole_x * 700 - whole_x.sum(0)) ** 2).sum(1)
    assert all(r.deviation == deviation[r.vec_id] for r in rows)


def test_equal_and_missing_variances(spark):
    corners = [(n, [float(n % 4 == k) for k in range(4)] + [0.5]) for n in range(80)]  # three equal roots, two of zero
    rows = whitening.whiten(spark.createDataFrame(corners, "vec_id long, embedding array<float>")).collect()
    assert len(rows) == 80 * 5 and {r.whitened for r in rows if r.component > 3} == {None}
    assert {round(r.explained, 12) for r in rows} == {round(1 / 3, 12), 0.0} and rows[0].identity_error < 1e-12
    alone = whitening.whiten(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(0, None, None, None)] * 2


def test_odd_vectors(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 2.0]), (3, [1e308, 2.0]), (None, [0.0, 1.0]), (1, [1e30, 0.0]), (5, [1.0, 2.0, 3.0]),
            (6, [2.0, 2.0, 3.0]), (7, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n string, component int")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted(
        [(i, c) for i in (1, 2, 3, -1, 1) for c in (1, 2)] + [(i, c) for i in (5, 6) for c in (1, 2, 3)])
    assert {r.deviation for r in got if r.vec_id == 3} == {None} and {r.n for r in got if r.vec_id in (5, 6)} == {2}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter(F.col("vec_id") == 7)).count() == 0
