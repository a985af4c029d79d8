"""Near duplicates against all pairs of a small table, and the stages of the method by themselves."""

import itertools
import random

import numpy as np
import pytest

from statloom.llm import groups, minhash
from statloom.llm.components import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(zip(*[words[i:] for i in range(size)]))


def brute(rows, plan):
    sets, parent = {i: shingles(t, plan.shingle) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        one, other = sets[a], sets[b]
        common = len(one & other)
        if one and other and 100 * common >= plan.percent * (len(one) + len(other) - common):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}, sets


@pytest.fixture(scope="module")
def families():
    """Copies of copies with few and many edits, and one passage that many texts share."""
    rng = random.Random(4)
    words, texts = [f"w{n}" for n in range(3000)], []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.choice([8, 20, 60, 200]))]
        for copy in range(rng.choice([2, 10, 40])):
            text = list(rng.choice([base, texts[-1].split() if copy else base]))
            for _ in range(int(len(text) * rng.choice([0, .01, .02, .05, .1, .15]))):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(50):
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(60)), *passage, *rng.choices(words, k=rng.randrange(20))]))
    rows = list(enumerate([*texts, "", "a", "a b", "A b", None, texts[0].upper()]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("plan, block, levels", [(minhash.NearPlan(), 512, 8), (minhash.NearPlan(shingle=3, percent=85), 7, 8),
                                                 (minhash.NearPlan(shingle=3, percent=85), 7, 0)])
def test_components_equal_all_pairs(spark, families, plan, block, levels, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", block)
    monkeypatch.setattr(groups, "DIRECT", 1)
    monkeypatch.setattr(groups, "LEVELS", levels)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(5)
    want, sets = brute(families, plan)
    rows = minhash.near_duplicates(docs, plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = minhash.drop_near_duplicates(docs, plan).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**64, 1300, dtype=np.uint64)
    sets = np.concatenate([values[:1000], values[300:]])  # 700 of 1300 in common
    agreed = (lambda s: (s[0] == s[1]).mean())(minhash.signatures(sets, np.array([0, 1000]), 2000))
    assert abs(agreed - 700 / 1300) < 0.05


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(n, n + 1) for n in range(300, 340)]
    links = [(a, b) for a, b in links if a != b]
    parent = {n: n for link in links for n in link}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == parent and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert [r.component_id for r in rows if r.doc_id in (5, 6)] == [5, 5, 5] and all(r.component_id == 3 for r in rows if r.doc_id == 3)
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0 and minhash.drop_near_duplicates(odd.limit(0)).count() == 0
