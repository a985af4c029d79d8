"""The size-aware join against all pairs of a small table, and its steps by themselves."""

import itertools
import random

import numpy as np
import pytest

from statloom.llm import groups, heavylight
from test_minhash import brute


@pytest.fixture(scope="module")
def texts():
    """Families of copies around the threshold, of small and large sets, and a passage that most of one kind share."""
    rng = random.Random(11)
    words, out = [f"w{n}" for n in range(4000)], []
    for size in (3, 4, 6, 9, 11, 12, 13, 20, 21, 22, 30, 60, 200, 400):
        base = rng.choices(words, k=size)
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[], [rng.choice(words)], [text[at], rng.choice(words)]])
            out.append(" ".join(rng.choice([text, text + text[:3]])))
    passage = rng.choices(words, k=60)
    for _ in range(60):
        out.append(" ".join([*rng.choices(words, k=rng.randrange(9)), *passage, *rng.choices(words, k=rng.randrange(4))]))
    rows = list(enumerate([*out, "", None, "a", "a b", "A b", out[0].upper(), " \t "]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("plan, block", [(heavylight.JoinPlan(), 512), (heavylight.JoinPlan(percent=80), 7)])
def test_components_equal_all_pairs(spark, texts, plan, block, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", block)
    monkeypatch.setattr(groups, "DIRECT", 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want, sets = brute(texts, plan)
    rows = heavylight.join(docs, plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(rows) == len(texts)


@pytest.mark.parametrize("x", [0, 12, 25])
def test_any_boundary_gives_the_same_links(spark, texts, x, monkeypatch):
    monkeypatch.setattr(heavylight, "boundary", lambda lists, plan: x)
    some = [r for r in texts if r[1] is None or len(r[1]) < 400]
    want, _ = brute(some, heavylight.JoinPlan())
    rows = heavylight.join(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_small_sets_share_a_subset(percent):
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 23)
        one = rng.sample(range(10**9), n)
        other = [*rng.sample(one, rng.randrange(max(1, n - 3), n + 1)), *rng.sample(range(10**9), rng.randrange(3))]
        keys = [set(heavylight.subset_keys(np.array(s, np.int64), percent).tolist()) for s in (one, other)]
        common = len(set(one) & set(other))
        assert len(keys[0]) == heavylight.subset_count(n, percent)
        if 100 * common >= percent * (len(one) + len(other) - common):
            assert keys[0] & keys[1]


@pytest.mark.parametrize("percent", [80, 90, 99])
def test_bands_adjoin(percent):
    sizes = np.arange(1, 3000)
    band = heavylight.bands_of(sizes, percent)
    for n in range(1, 3000):
        partners = band[n - 1:100 * n // percent]
        assert partners.max() - band[n - 1] <= 1
    assert (np.diff(band) >= 0).all()


def test_boundary_has_the_least_cost(spark):
    plan = heavylight.JoinPlan()
    short = spark.createDataFrame([(i, 12, 2) for i in range(50)], "id long, n long, length long")
    long_ = spark.createDataFrame([(i, 12, 5000) for i in range(50)], "id long, n long, length long")
    assert heavylight.boundary(short, plan) == 0 and heavylight.boundary(long_, plan) >= 13
    assert heavylight.boundary(short.limit(0), plan) == 0


def shared_passage(count):
    rng = random.Random(1)
    passage = [f"p{n}" for n in range(60)]
    own = itertools.count()
    return [(n, " ".join([*[f"o{next(own)}" for _ in range(rng.randrange(20, 60))], *passage,
                          *[f"o{next(own)}" for _ in range(rng.randrange(20))]])) for n in range(count)]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    from statloom.llm import minhash
    made = []

    def counting(df, name, by=()):
        kept = real(df, name, by)
        if name in ("stars", "dealt", "differences", "regrouped"):
            made.append(kept.count())
        return kept

    real = groups.stored
    monkeypatch.setattr(groups, "stored", counting)
    monkeypatch.setattr(groups, "BLOCK", 32)
    monkeypatch.setattr(groups, "DIRECT", 1)
    rows = []
    for count in (400, 1600):
        docs = spark.createDataFrame(shared_passage(count), "doc_id long, text string")
        made.clear()
        assert minhash.near_duplicates(docs, minhash.NearPlan(shingle=3)).filter("not kept").isEmpty()
        rows.append(sum(made))
    assert rows[0] and rows[1] <= rows[0] * 4 ** 1.2


def test_odd_rows(odd):
    rows = heavylight.join(odd).collect()
    assert len(rows) == odd.count()
    assert [r.component_id for r in rows if r.doc_id in (5, 6)] == [5, 5, 5] and all(r.component_id == 3 for r in rows if r.doc_id == 3)
    assert heavylight.join(odd.limit(0)).count() == 0
