"""Fitted classifiers: accuracy on rows that the fit leaves aside, and the rows that every operator must take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import mil, toxicity
from statloom.llm.fitting import Sample, labelled_sample, remainder
from statloom.llm.subwords import subword_buckets
from statloom.llm.text import split


def test_toxic_rows_are_found_and_clean_ones_left(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from(docs, labels, remainder("doc_id", 3) != 1)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 3) == 1).collect()
    toxic, clean = ([r.score >= 0.7 for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean(toxic) > 0.3 and np.mean(clean) < 0.03  # 18 rows, 33 to learn from; large tables give 0.99
    base = "these are quite ordinary words in a row that nobody minds at all "
    bad = toxicity.fit(Sample(*_sample([(base + w) * 3 for w in ("idiot", "moron", "pathetic")] * 20 + [base * 3, base[9:] * 2] * 30, [1] * 60 + [0] * 60)))
    scores = _score(bad, [base + "idiiot", base + "patheticc", base])
    assert scores[0] > scores[2] and scores[1] > scores[2]


def _sample(texts, labels):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]).astype(np.int64), np.array(labels)


def _score(model, texts):
    data, offsets, label = _sample(texts, [0] * len(texts))
    return toxicity.score_texts(model, Sample(data, offsets, label).words(alphanumeric=True))


def test_quality_on_rows_left_aside(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = mil.fit_from(docs, labels, remainder("doc_id", 5) != 0)
    rows = mil.score(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0).collect()
    good, junk = ([r.score >= 0.3 for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.2


def test_gradients_of_the_bag_model():
    rng = np.random.default_rng(1)
    sizes, begin = np.array([3, 1, 4]), np.array([0, 3, 4])
    x, label = rng.standard_normal((8, 5)), np.array([1, 0, 1])
    w = {"encode": rng.standard_normal((5, 4)), "encode0": rng.standard_normal(4), "v": rng.standard_normal((4, 3)), "u": rng.standard_normal((4, 3)),
         "attend": rng.standard_normal(3), "out": rng.standard_normal(4), "out0": rng.standard_normal(1), "mean": np.zeros(5), "spread": np.ones(5)}

    def loss():
        p = mil._forward(w, x, begin, sizes)["p"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    exact = mil._gradients(w, x, begin, mil._forward(w, x, begin, sizes), label)
    for name, gradient in exact.items():
        at = tuple(0 for _ in w[name].shape)
        w[name][at] += 1e-6
        up = loss()
        w[name][at] -= 2e-6
        down = loss()
        w[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - gradient[at]) < 1e-6, name


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (mil, "quality")])
def test_odd_rows(odd, some_labels, operator, label):
    model = operator.fit_from(odd, some_labels)
    rows = operator.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert operator.score(odd, model, "fresh").columns == [*odd.columns, "fresh"]
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    prior = operator.fit_from(odd, some_labels.limit(0))
    assert np.allclose([r.score for r in operator.score(odd, prior).collect()], 0.5)
    assert operator.score(odd.limit(0), prior).count() == 0


def test_sample_leaves_out_contradictions_and_is_bounded(odd, some_labels):
    sample = labelled_sample(odd, some_labels, "quality", None, 10, 1000)
    assert sample.label.tolist().count(1) == 1 and sample.label.tolist().count(0) == 2  # 1, and 5 twice; 7 is too long
    assert len(labelled_sample(odd, some_labels, "quality", F.col("doc_id") != 5, 1, 1_000_000).label) == 1


def by_hand(model, text):
    """The score of a text by plain loops: the strongest of all spans, a span being the mean of its distinct words."""
    plan = model.plan
    words = split(*_sample([text], [0])[:2], alphanumeric=True)
    logits = []
    for n in range(len(words.start)):
        span = {}
        for k in range(n, min(n + plan.span, len(words.start))):
            bucket, _ = subword_buckets(words, np.array([k]), plan.grams, plan.buckets, whole=False)
            span[bytes(words.data[words.start[k]:words.end[k]])] = float(np.mean(model.weight[bucket].astype(float)))
        logits.append(sum(span.values()) / max(len(span), plan.least) + model.bias)
    return 1 / (1 + np.exp(-max(logits, default=model.bias)))


def test_toxicity_is_that_of_plain_loops_and_stays_wherever_a_phrase_stands(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from(docs, labels, remainder("doc_id", 3) != 1)
    rows = docs.join(labels, "doc_id").filter((remainder("doc_id", 3) == 1) & F.col("text").isNotNull()).orderBy("doc_id").collect()
    some = [r.text for r in rows[:40]] + ["", "  ", "one", "same " * 30, "a b " * 7 + "c", "é ü 日本 |x| y"]
    assert np.allclose(_score(model, some), [by_hand(model, t) for t in some], atol=1e-7)
    alone = [_score(model, [t])[0] for t in some]
    assert alone == _score(model, some).tolist()  # whatever else is in the chunk
    toxic = [r.text for r in rows if r.toxic == 1 and len(r.text.split()) >= 12]
    found = [t for t, p in zip(toxic, _score(model, toxic)) if p >= 0.7]
    before = "the and of with from this that when where then".split()
    assert found
    for n in range(1, 12):
        assert all(p >= 0.7 for p in _score(model, [" ".join((before * 2)[:n]) + " " + t for t in found]))
    clean = [r.text for r in rows if r.toxic == 0]
    assert np.mean(_score(model, [" ".join(before) + " " + t for t in clean]) >= 0.7) < 0.03
