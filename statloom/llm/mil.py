"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded: hashed byte bigrams and trigrams and a few
shares (capitals, digits, symbols, repeated words, …) go through a learned layer. Gated attention, a softmax over
the bag of ``w · (tanh(V h) * sigmoid(U h))``, weights the passages, and a logistic output reads the weighted mean. All
weights are learned together from document labels only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from statloom.llm.fitting import Adam, Sample, labelled_sample, sigmoid, with_excerpts
from statloom.llm.subwords import ragged
from statloom.llm.text import Words, binary_parts, map_texts, split

SHARES = 7


@dataclass(frozen=True)
class QualityPlan:
    passage: int = 48           # words
    buckets: int = 256          # of bigrams, and as many of trigrams
    excerpt: int = 20           # words that excerpts for training stay below
    hidden: int = 24
    gate: int = 12
    epochs: int = 20
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    per_class: int = 1000       # labelled documents of each label that the fit may use
    longest: int = 12_000       # bytes of the longest of them
    seed: int = 6


@dataclass(frozen=True)
class QualityModel:
    """``weights`` is None where the sample had no two labels; then ``prior`` is every document's score."""

    plan: QualityPlan
    weights: dict[str, np.ndarray] | None
    prior: float


def _kinds() -> np.ndarray:
    kind = np.zeros((4, 256), bool)
    kind[0, 0x41:0x5B] = True
    kind[1, 0x30:0x3A] = True
    kind[2, [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
    kind[3, 0x0A] = True
    return kind


_KINDS = _kinds()


def passages(words: Words, plan: QualityPlan) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage, and the first passage of each text (one more at the end)."""
    per_text = -(-words.counts // plan.passage)
    first = np.concatenate([[0], np.cumsum(per_text)])
    count = int(first[-1])
    if not count:
        return np.zeros((0, 2 * plan.buckets + SHARES), np.float32), first
    begin = ragged(np.zeros(len(per_text), np.int64), per_text) * plan.passage + np.repeat(words.first[:-1], per_text)
    size = np.minimum(begin + plan.passage, np.repeat(words.first[1:], per_text)) - begin
    start, stop = words.start[begin], words.end[begin + size - 1]
    at = ragged(start, stop - start)
    owner = np.repeat(np.arange(count), stop - start)
    near = words.data.astype(np.uint32)
    near = np.concatenate([near, np.zeros(2, np.uint32)])
    two = near[:-1] * np.uint32(0x9E3779B1) + near[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + near[2:] * np.uint32(0x27D4EB2F)
    out = np.empty((count, 2 * plan.buckets + SHARES), np.float32)
    length = (stop - start).astype(np.float64)
    for n, grams in enumerate((two, three)):
        bucket = (grams[at] ^ (grams[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)
        held = np.bincount(owner * plan.buckets + (bucket % np.uint32(plan.buckets)), minlength=count * plan.buckets)
        out[:, n * plan.buckets:(n + 1) * plan.buckets] = np.sqrt(held.reshape(count, -1) / length[:, None])
    shares = out[:, 2 * plan.buckets:]
    sums = np.zeros(len(words.data) + 1, np.int64)
    for n, kind in enumerate(_KINDS):
        np.cumsum(kind[words.data], out=sums[1:])
        shares[:, n] = np.sqrt((sums[stop] - sums[start]) / length)
    hashes = words.hashes()
    word = ragged(begin, size)
    of_word = np.repeat(np.arange(count), size)
    order = np.lexsort((hashes[word], of_word))
    same = (hashes[word][order[1:]] == hashes[word][order[:-1]]) & (of_word[order[1:]] == of_word[order[:-1]])
    shares[:, 4] = np.bincount(of_word[order[1:]][same], minlength=count) / size
    following = (hashes[word][1:] == hashes[word][:-1]) & (of_word[1:] == of_word[:-1])
    shares[:, 5] = np.bincount(of_word[1:][following], minlength=count) / size
    shares[:, 6] = np.log(length / size)
    return out, first


def _forward(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Bags of at least one passage, in ``x`` one after the other."""
    bag = np.repeat(np.arange(len(begin)), sizes)
    h = np.tanh(((x - w["mean"]) / w["spread"]) @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
    energy = (t * g) @ w["attend"]
    raised = np.exp(energy - np.maximum.reduceat(energy, begin)[bag])
    a = raised / np.add.reduceat(raised, begin)[bag]
    z = np.add.reduceat(a[:, None] * h, begin)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ w["out"] + w["out0"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, f: dict[str, np.ndarray],
               label: np.ndarray) -> dict[str, np.ndarray]:
    wrong = (f["p"] - label) / len(label)
    of_z = (wrong[:, None] * w["out"])[f["bag"]]
    of_a = (of_z * f["h"]).sum(1)
    of_energy = f["a"] * (of_a - np.add.reduceat(f["a"] * of_a, begin)[f["bag"]])
    of_both = of_energy[:, None] * w["attend"]
    of_t = of_both * f["g"] * (1 - f["t"] ** 2)
    of_g = of_both * f["t"] * f["g"] * (1 - f["g"])
    of_h = (f["a"][:, None] * of_z + of_t @ w["v"].T + of_g @ w["u"].T) * (1 - f["h"] ** 2)
    return {"encode": ((x - w["mean"]) / w["spread"]).T @ of_h, "encode0": of_h.sum(0), "v": f["h"].T @ of_t,
            "u": f["h"].T @ of_g, "attend": (f["t"] * f["g"]).T @ of_energy, "out": f["z"].T @ wrong,
            "out0": wrong.sum(keepdims=True)}


def fit(sample: Sample, plan: QualityPlan = QualityPlan()) -> QualityModel:
    if sample.usable:
        sample = with_excerpts(sample, plan.excerpt, plan.seed)
    counts = sample.words(lower=False).counts
    filled = np.flatnonzero(counts > 0)
    label = sample.label[filled]
    if not (label == 0).any() or not (label == 1).any():
        return QualityModel(plan, None, sample.prior)
    first = np.concatenate([[0], np.cumsum(-(-counts // plan.passage))])
    x = np.empty((first[-1], 2 * plan.buckets + SHARES), np.float32)
    for low, some in sample.lots():
        x[first[low]:first[low + len(some.label)]] = passages(some.words(lower=False), plan)[0]
    sizes, begin = np.diff(first)[filled], first[:-1][filled]
    rng = np.random.Generator(np.random.PCG64(plan.seed))

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"encode": start(x.shape[1], plan.hidden), "encode0": np.zeros(plan.hidden, np.float32),
         "v": start(plan.hidden, plan.gate), "u": start(plan.hidden, plan.gate), "attend": start(plan.gate),
         "out": start(plan.hidden), "out0": np.zeros(1, np.float32)}
    learned = Adam(w, plan.rate)
    mean = x.mean(0)
    variance = np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean ** 2, 0)
    fixed = {"mean": mean, "spread": (np.sqrt(variance) + 0.02).astype(np.float32)}
    for _ in range(plan.epochs):
        order = rng.permutation(len(filled))
        for lot in range(0, len(order), plan.batch):
            some = order[lot:lot + plan.batch]
            bags = x[ragged(begin[some], sizes[some])]
            at = np.cumsum(sizes[some]) - sizes[some]
            f = _forward(w | fixed, bags, at, sizes[some])
            gradients = _gradients(w | fixed, bags, at, f, label[some])
            gradients = {k: (g + plan.decay * w[k]).astype(np.float32) for k, g in gradients.items()}
            learned.step(gradients)
    return QualityModel(plan, w | fixed, sample.prior)


def score_texts(model: QualityModel, words: Words) -> np.ndarray:
    """The probability of label 1 of each text; a text without words has no passage and scores as an empty bag."""
    if model.weights is None:
        return np.full(len(words.counts), model.prior)
    x, first = passages(words, model.plan)
    sizes = np.diff(first)
    out = np.full(len(sizes), sigmoid(float(model.weights["out0"][0])), np.float64)
    filled = sizes > 0
    if filled.any():
        out[filled] = _forward(model.weights, x, first[:-1][filled], sizes[filled])["p"]
    return out


def fit_from(docs: DataFrame, labels: DataFrame, usable: Column | None = None,
             plan: QualityPlan = QualityPlan()) -> QualityModel:
    return fit(labelled_sample(docs, labels, "quality", usable, plan.per_class, plan.longest), plan)


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and ``name``, the probability that the whole ``text`` has quality label 1.

    NULL, empty and blank texts score as an empty bag. Every row is scored by itself, so repeated rows score alike. A
    column called ``name`` is replaced.
    """
    return map_texts(docs, {name: "double"}, lambda texts: [score_texts(model, split(*binary_parts(texts), lower=False))])
