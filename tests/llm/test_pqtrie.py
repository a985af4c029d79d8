"""Product codes against a plain loop over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from statloom.llm import pqtrie


def brute(rows, plan):
    usable = [(i, label, [math.floor(plan.scale * x) for x in v]) for i, v, label in rows
              if v and len(v) % plan.parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    assert len({len(v) for _, _, v in usable}) <= 1
    width = len(usable[0][2]) // plan.parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(plan.parts)] for _, _, v in usable]
    seeds = sorted((i, v) for i, _, v in usable if i is not None)[:plan.entries]
    books = [[v[p * width:(p + 1) * width] for _, v in seeds] for p in range(plan.parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(books[p])) for p, part in enumerate(parts)]
                for parts in cut]

    for _ in range(plan.rounds):
        found = assign()
        for p in range(plan.parts):
            for n in range(len(books[p])):
                mine = [parts[p] for parts, near in zip(cut, found) if near[p][1] == n]
                if mine:
                    books[p][n] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, label, "".join(f"{n:02x}" for _, n in near), sum(d for d, _ in near)) for (i, label, _), near in zip(usable, assign())]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted([(i, label, code, e, sum(x[3] for x in out if x[1] == label), sha) for i, label, code, e in out], key=str)


@pytest.mark.parametrize("subtree, chunk", [(1 << 12, 1 << 14), (3, 50)])
@pytest.mark.parametrize("scale, big", [(256, 1.0), (16, 1e20)])
def test_equals_plain_loop(spark, monkeypatch, subtree, chunk, scale, big):
    monkeypatch.setattr(pqtrie, "SUBTREE", subtree)
    monkeypatch.setattr(pqtrie, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(n, [rng.choice([rng.gauss(0, .1), .25, -.5]) for _ in range(12)], rng.choice([1, 2, None])) for n in range(250)]
    rows += [(n, rows[0][1], 2) for n in range(250, 300)] + [(7, rows[8][1], 1), (None, rows[9][1], 3), (300, [big] * 12, 4)]
    rows += [(-5, None, 1), (-6, [], 1), (-7, [1.0, None] * 6, 1), (-8, [math.nan] * 12, 1), (-9, [math.inf] * 12, 1), (-10, [1.0] * 5, 1)]
    plan = pqtrie.CodePlan(scale=scale, parts=4, entries=8)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in pqtrie.compress(df, plan).collect()]
    want = [(*w[:3], *[e if e < 2**63 else None for e in w[3:5]], w[5]) for w in brute(rows, plan)]
    assert sorted(got, key=str) == want


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(4, [0.5] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error) for r in pqtrie.compress(one).collect()] == [("00" * 16, 0)]
    assert pqtrie.compress(one.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, [0.5] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert pqtrie.compress(nobody).count() == 0
    mixed = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.25] * 32, None), (3, [0.0] * 32, None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.code[:2], r.error) for r in pqtrie.compress(mixed).collect()) == [(1, "00", 0), (2, "00", 0), (3, "01", 0)]


@pytest.mark.parametrize("subtree", [2, 1 << 12])
def test_prefixes_are_shared(monkeypatch, subtree):
    monkeypatch.setattr(pqtrie, "SUBTREE", subtree)
    rng = np.random.default_rng(4)
    parts = rng.integers(0, 6, (3000, 4))
    codebook = rng.integers(0, 6, (16, 4))
    trie = pqtrie.Trie(parts)
    best, error, computed = trie.nearest(codebook)
    distances = ((parts[:, None, :] - codebook[None]) ** 2).sum(2)
    assert (best[trie.leaf_of] == distances.argmin(1)).all() and (error[trie.leaf_of] == distances.min(1)).all()
    prefixes = sum(len(np.unique(parts[:, :d], axis=0)) for d in range(1, 5))
    assert computed == prefixes * 16 and trie.weight.sum() == 3000
