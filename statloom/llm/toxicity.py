"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams, ends marked, so a misspelt or compounded word shares most
of its vectors with those seen in training. A span is the mean of its distinct words and a linear softmax
reads it; a document scores as its most toxic span, so a few words count in a text of any length. A span begins at every
word, so words in front of a phrase don't change its score. Training starts with spans side by side under their document's
label, then goes on with the strongest span of each toxic document and the strongest spans of clean ones. Vectors and
softmax are fitted together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from statloom.llm.fitting import Sample, labelled_sample, sigmoid
from statloom.llm.subwords import ragged, subword_buckets
from statloom.llm.text import Words, binary_parts, map_texts, split


_ONE = float(1 << 30)  # means are rounded to parts of this


@dataclass(frozen=True)
class ToxicityPlan:
    buckets: int = 1 << 17
    size: int = 8               # of a vector
    grams: tuple[int, ...] = (3, 4, 5)
    span: int = 12              # words in a span
    least: int = 8              # words that a shorter span counts as
    least_texts: int = 3        # texts of the sample in which an n-gram must stand to be learnt
    first_spans: int = 100      # spans of a text, picked by chance, with which training starts
    rounds: int = 6             # of training on strongest spans
    rate: float = 0.5
    per_class: int = 1500       # labelled documents of each label that the fit may use
    longest: int = 12_000       # bytes of the longest of them
    seed: int = 10


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the logit difference that each bucket adds, and the bias."""

    plan: ToxicityPlan
    weight: np.ndarray
    bias: float


def _spans(words: Words, plan: ToxicityPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each span, its number of words, and the first span of each text (one more at the end).

    A span begins at every word, the last ones of a text being shorter: words put in front of a text take none away.
    """
    start = np.arange(len(words.start))
    return start, np.minimum(np.repeat(words.first[1:], words.counts) - start, plan.span), words.first


def _span_logits(words: Words, word: np.ndarray, means: np.ndarray, start: np.ndarray, plan: ToxicityPlan, bias: float) -> np.ndarray:
    """The logit of every span, from the number of each word and the means of these numbers.

    A word counts for the spans that begin after the word before it that is equal, and reach it: running sums of what
    comes in and goes out. They are taken over whole numbers, so a text's score does not depend on others in its chunk.
    """
    at = np.arange(len(word))
    order = np.argsort(word, kind="stable")
    again = np.flatnonzero(word[order[1:]] == word[order[:-1]])
    since = np.maximum(at - plan.span + 1, np.repeat(words.first[:-1], words.counts))
    since[order[again + 1]] = np.maximum(since[order[again + 1]], order[again] + 1)
    value = np.rint(means[word] * _ONE)
    sums, sizes = ((np.cumsum((np.bincount(since, v, len(at)) - np.append(0, v[:-1])).astype(np.int64)))
                   for v in (value, np.ones(len(at))))
    return sums[start] / _ONE / np.maximum(sizes[start], plan.least) + bias


def _distinct(word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the spans are the first of their kind in their span, and how many those are per span."""
    span = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((word, span))
    again = np.zeros(len(word), bool)
    again[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
    return ~again, np.bincount(span[~again], minlength=len(size))


def score_texts(model: ToxicityModel, words: Words) -> np.ndarray:
    """The probability of toxicity of each text; a text without words scores as an empty span."""
    plan = model.plan
    start, _, first = _spans(words, plan)
    best = np.full(len(words.counts), model.bias)
    if len(start):
        _, shown, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
        bucket, owner = subword_buckets(words, shown, plan.grams, plan.buckets, whole=False)
        means = np.bincount(owner, model.weight[bucket], len(shown)) / np.bincount(owner, minlength=len(shown))
        spans = _span_logits(words, place, means, start, plan, model.bias)
        filled = words.counts > 0
        best[filled] = np.maximum.reduceat(spans, first[:-1][filled])
    return sigmoid(best)


class _Fit:
    """Joint training of vectors and softmax on the spans of a sample."""

    def __init__(self, sample: Sample, plan: ToxicityPlan):
        self.plan, self.rng = plan, np.random.Generator(np.random.PCG64(plan.seed))
        self.words = sample.words(alphanumeric=True)
        _, shown, self.word = np.unique(self.words.hashes(), return_index=True, return_inverse=True)
        found, parts = [], []
        for low in range(0, len(shown), 20_000):
            bucket, owner = subword_buckets(self.words, shown[low:low + 20_000], plan.grams, plan.buckets, whole=False)
            found.append(bucket[np.argsort(owner, kind="stable")])
            parts.append(np.bincount(owner, minlength=len(shown[low:low + 20_000])))
        self.bucket, self.parts = np.concatenate(found), np.concatenate(parts)
        self.begin = np.cumsum(self.parts) - self.parts
        self.start, self.size, self.first = _spans(self.words, plan)
        self.text = np.repeat(np.arange(len(sample.label)), np.diff(self.first))
        self.label = sample.label
        self.softmax = self.rng.uniform(-1, 1, (plan.size, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self._start()
        self.seen = np.full(plan.buckets, 1e-6, np.float32)  # squared gradients, for the step size of each bucket
        self.seen_softmax = np.float32(1e-6)

    def _start(self) -> None:
        """Which buckets several texts have, and vectors that set out from how differently both labels have them.

        What only one or two texts have would just be learnt by heart.
        """
        once = np.unique(self.words.text_of * np.int64(len(self.parts)) + self.word)
        texts, held = np.bincount(self.label, minlength=2), np.zeros((2, self.plan.buckets), np.int64)
        edges = np.searchsorted(once, np.arange(len(self.label) + 1) * np.int64(len(self.parts)))
        for text, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            word = once[low:high] % len(self.parts)
            held[self.label[text], np.unique(self.bucket[ragged(self.begin[word], self.parts[word])])] += 1
        self.common = held[0] + held[1] >= self.plan.least_texts
        odds = np.log((held[1] + 0.5) / (texts[1] + 1)) - np.log((held[0] + 0.5) / (texts[0] + 1))
        direction = self.softmax[:, 1] - self.softmax[:, 0]
        self.vectors = (np.where(self.common, odds, 0.0)[:, None] * direction / (direction @ direction)).astype(np.float32)

    def train(self, spans: np.ndarray, labels: np.ndarray, batch: int = 64) -> None:
        """One pass over the spans; both labels weigh the same."""
        toxic = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))
        order = self.rng.permutation(len(spans))
        for lot in range(0, len(order), batch):
            some = order[lot:lot + batch]
            self._step(spans[some], labels[some], weight[some])

    def _step(self, spans: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> None:
        word = self.word[ragged(self.start[spans], self.size[spans])]
        new, size = _distinct(word, self.size[spans])
        word = word[new]
        parts = self.parts[word]
        entry = self.bucket[ragged(self.begin[word], parts)]
        of_span = np.repeat(np.repeat(np.arange(len(spans)), size), parts)
        weight = np.repeat(1.0 / (parts * np.repeat(np.maximum(size, self.plan.least), size)), parts).astype(np.float32)
        several = self.common[entry]
        entry, of_span, weight = entry[several], of_span[several], weight[several]
        used, place = np.unique(entry, return_inverse=True)
        # a dense matrix of this batch's spans by the buckets they use
        bag = np.bincount(of_span * len(used) + place, weight, len(spans) * len(used)).astype(np.float32)
        bag = bag.reshape(len(spans), len(used))
        hidden = bag @ self.vectors[used]
        logits = hidden @ self.softmax + self.bias
        wrong = (sigmoid(logits[:, 1] - logits[:, 0]) - labels) * importance
        error = (np.stack([-wrong, wrong], 1) / len(spans)).astype(np.float32)
        of_vectors = bag.T @ (error @ self.softmax.T)
        of_softmax = hidden.T @ error
        self.seen[used] += (of_vectors ** 2).mean(1)
        self.vectors[used] -= self.plan.rate * of_vectors / np.sqrt(self.seen[used])[:, None]
        self.seen_softmax += (of_softmax ** 2).mean()
        self.softmax -= self.plan.rate * 0.2 * of_softmax / np.sqrt(self.seen_softmax)
        self.bias -= self.plan.rate * error.sum(0)

    def _aside(self) -> np.ndarray:
        """Which spans stand side by side in their texts, from a place picked by chance on."""
        inner = np.arange(len(self.text)) - self.first[self.text]
        phase = self.rng.integers(0, self.plan.span, len(self.label))[self.text]
        phase = np.minimum(phase, np.diff(self.first)[self.text] - 1)
        return (inner - phase) % self.plan.span == 0

    def some_spans(self, most: int) -> np.ndarray:
        aside = np.flatnonzero(self._aside())
        return self._first_of_texts(aside[np.lexsort((self.rng.random(len(aside)), self.text[aside]))], most)

    def _first_of_texts(self, spans: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        """Of spans in the order of their texts the first ``most`` of each."""
        held = np.bincount(self.text[spans], minlength=len(self.label))
        return spans[ragged(np.zeros(len(held), np.int64), held) < most]

    def strongest(self, model: ToxicityModel) -> np.ndarray:
        """The strongest span of each toxic text and three of each clean one, no two of them in one stretch of a span."""
        logits = self.span_logits(model)
        inner = np.arange(len(self.text)) - self.first[self.text]
        stretch = np.cumsum(inner % self.plan.span == 0)
        order = np.lexsort((-logits, stretch))
        tops = order[np.append(True, stretch[order[1:]] != stretch[order[:-1]])]
        tops = tops[np.lexsort((-logits[tops], self.text[tops]))]
        return self._first_of_texts(tops, np.where(self.label[self.text[tops]] == 1, 1, 3))

    def model(self) -> ToxicityModel:
        difference = self.softmax[:, 1] - self.softmax[:, 0]
        return ToxicityModel(self.plan, (self.vectors @ difference).astype(np.float32), float(self.bias[1] - self.bias[0]))

    def span_logits(self, model: ToxicityModel) -> np.ndarray:
        means = np.add.reduceat(model.weight[self.bucket], self.begin) / self.parts
        return _span_logits(self.words, self.word, means, self.start, self.plan, model.bias)


def fit(sample: Sample, plan: ToxicityPlan = ToxicityPlan()) -> ToxicityModel:
    """A model from labelled texts; without both labels it gives every text the sample's share of label 1."""
    words = sample.words(alphanumeric=True)
    if not sample.usable or not len(words.start):
        odds = np.clip(sample.prior, 1e-6, 1 - 1e-6)
        return ToxicityModel(plan, np.zeros(plan.buckets, np.float32), float(np.log(odds / (1 - odds))))
    fit_ = _Fit(sample, plan)
    some = fit_.some_spans(plan.first_spans)
    fit_.train(some, fit_.label[fit_.text[some]])
    for _ in range(plan.rounds):
        chosen = fit_.strongest(fit_.model())
        fit_.train(chosen, fit_.label[fit_.text[chosen]])
    return fit_.model()


def fit_from(docs: DataFrame, labels: DataFrame, usable: Column | None = None,
             plan: ToxicityPlan = ToxicityPlan()) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", usable, plan.per_class, plan.longest), plan)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and ``name``, the probability that the whole ``text`` is toxic.

    NULL and empty texts, and those without a letter or digit, score as an empty span. Every row is scored by itself,
    so repeated rows score alike. A column called ``name`` is replaced.
    """
    return map_texts(docs, {name: "double"}, lambda texts: [score_texts(model, split(*binary_parts(texts), alphanumeric=True))])
