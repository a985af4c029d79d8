"""Katz backoff against a direct computation with dictionaries, with and without head, splits and many buckets."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statloom.llm import katz
from statloom.llm.fitting import remainder

PLANS = {"all in the head": katz.KatzPlan(), "small head": katz.KatzPlan(head=6, bucket_tokens=150, split_tokens=40),
         "no head": katz.KatzPlan(head=0, bucket_tokens=500, least_buckets=1)}


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def discounts(types):
    n = [types.get(r, 0) for r in range(7)]
    out = {}
    for r in range(1, 6):
        d = -1.0
        if n[1] and n[r] and n[6] and 6 * n[6] / n[1] < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - 6 * n[6] / n[1]) / (1 - 6 * n[6] / n[1])
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Direct:
    def __init__(self, texts):
        self.uni, self.bi, self.after = Counter(), Counter(), defaultdict(dict)
        for text in texts:
            history = "start"
            for token in tokens_of(text):
                self.uni[token] += 1
                self.bi[history, token] += 1
                history = token
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = discounts(Counter(self.uni.values())), discounts(Counter(self.bi.values()))
        self.unknown = 1 - sum(self.d1.get(c, 1) * c for c in self.uni.values()) / (self.n + 1)
        self.seen = Counter()
        for (h, w), c in self.bi.items():
            self.seen[h] += c
            self.after[h][w] = c

    def p1(self, w):
        c = self.uni.get(w, 0)
        return self.d1.get(c, 1) * c / (self.n + 1) if c else self.unknown

    def p(self, h, w):
        after = self.after.get(h)
        if not after:
            return self.p1(w)
        pair = {x: self.d2.get(c, 1) * c / (self.seen[h] + 1) for x, c in after.items()}
        if w in pair:
            return pair[w]
        return (1 - sum(pair.values())) / (1 - sum(map(self.p1, after))) * self.p1(w)

    def score(self, text):
        total, history = 0.0, "start"
        for token in tokens_of(text):
            total += math.log10(self.p(history, token))
            history = token
        return total


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [f"w{n}" for n in range(60)] + ["The", "the", "é", "w1,"]
    made = [(n, " ".join(rng.choice(words[:rng.choice((3, 10, 64))]) for _ in range(rng.randrange(0, 40)))) for n in range(120)]
    return made + [(120, None), (121, ""), (122, " \n\t "), (None, "w1 w2"), (7, made[7][1]), (123, "w1 " * 400), (124, "odd w0 new")]


@pytest.mark.parametrize("name", list(PLANS))
def test_scores_equal_direct_computation(spark, texts, name):
    learned = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    direct = Direct(learned)
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, train string").repartition(3)
    rows = katz.katz_scores(docs, remainder("doc_id", 7) != 2, PLANS[name]).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6),
                   r.train_tokens, r.trained) for r in rows))
    want = sorted((i if i is not None else -1, len(tokens_of(t)), sum(w in direct.uni for w in tokens_of(t)),
                   round(sum(math.log10((direct.uni[w] + 1) / (direct.n + direct.v + 1)) for w in tokens_of(t)), 6),
                   round(direct.score(t), 6), direct.n, i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
                  for i, t in texts)
    assert got == want


def test_every_history_sums_to_one(texts):
    direct = Direct([t for _, t in texts])
    for history in ["start", b"w1", b"the", b"never seen"]:
        assert math.isclose(sum(direct.p(history, w) for w in direct.uni) + direct.p(history, "unknown"), 1.0)


def test_without_training_rows_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = katz.katz_scores(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert katz.katz_scores(docs.limit(0), F.lit(True)).count() == 0
