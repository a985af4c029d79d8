"""Training order: the permutation is one, and shards give back every document."""

from collections import Counter

import numpy as np
import pytest

from statloom.llm import materialise
from statloom.llm.tokens import encoder


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(size):
    numbers = np.arange(size)
    there = materialise.feistel(numbers, size, 7)
    assert sorted(there.tolist()) == numbers.tolist()
    assert materialise.feistel(there, size, 7, back=True).tolist() == numbers.tolist()
    if size > 60:
        assert there.tolist() != materialise.feistel(numbers, size, 8).tolist()


def test_round_trip(spark, tmp_path):
    plan = materialise.OrderPlan(length=32, largest=256)
    rows = [(n, ("word%d " % n) * (n % 50)) for n in range(300)] + [(300, None), (301, ""), (None, "x  y"), (5, "word5 " * 5), (302, "long text " * 4000)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, slot double").repartition(3)
    index = sorted(materialise.materialise(docs, str(tmp_path / "order"), plan).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index))) and len({r.shard for r in index}) > 1
    records = list(materialise.read_slots(str(tmp_path / "order")))
    assert len(records) == len(index) and all(len(r) == 32 for r in records)
    assert [r.tolist() for r in materialise.read_slots(str(tmp_path / "order"), 250, 20)] == [r.tolist() for r in records[250:270]]

    order = materialise.feistel(np.arange(len(index)), len(index), plan.key, plan.rounds)
    stream = [i for s in order for i in records[s][:index[s].n_tokens].tolist()]
    texts, text = Counter(), []
    for i in stream:
        if i == plan.end:
            texts[tuple(text)] += 1
            text = []
        else:
            text.append(i)
    whole = encoder(None)._whole([t or "" for _, t in rows])
    assert not text and texts == Counter(tuple(x.tolist()) for x in whole)
    held = Counter(d for s in order for d in index[s].doc_ids)
    assert set(held) == {i for i, _ in rows} and held[302] > 100
    assert all(index[s].doc_ids for s in order)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert materialise.materialise(docs, str(tmp_path / "none")).count() == 0
    assert list(materialise.read_slots(str(tmp_path / "none"))) == []
