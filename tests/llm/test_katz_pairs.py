"""Frequent token pairs: no bucket holds their occurrences, and scores stay those of a direct computation."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from statloom.llm import katz
from statloom.llm.fitting import remainder
from test_katz import Direct, tokens_of


def learnt(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(40)]
    out = []
    for n in range(300):
        some = [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        some += ["one", "pair"] * rng.randrange(0, 6)
        some += [] if learnt(n) else rng.choice((["new", "word"], ["w1", "w1"], ["one", "one"], ["w2", "new"])) * 9
        out.append((n, " ".join(some)))
    return out


@pytest.mark.parametrize("head", [0, 8, 1 << 19])
def test_scores_with_frequent_pairs_equal_direct_computation(spark, texts, head):
    direct = Direct([t for i, t in texts if learnt(i)])
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    plan = katz.KatzPlan(head=head, bucket_tokens=300, split_tokens=30)
    got = {r.doc_id: r for r in katz.katz_scores(docs, remainder("doc_id", 7) != 2, plan).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        assert got[i].score == pytest.approx(direct.score(text), abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens_of(text)), sum(w in direct.uni for w in tokens_of(text)))


def test_a_bucket_does_not_grow_with_one_pair(spark, monkeypatch):
    groups, counted = [], katz._counted

    def seen(dealt, *rest):
        groups.extend(r["n"] for r in dealt.filter("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
        return counted(dealt, *rest)

    monkeypatch.setattr(katz, "_counted", seen)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one pair "), 50).alias("text")).repartition(4)
    rows = katz.katz_scores(docs, F.lit(True), katz.KatzPlan(bucket_tokens=2000, split_tokens=500)).collect()
    assert len({round(r.score, 9) for r in rows}) == 1 and len(rows) == 400
    assert max(groups) < 2000
