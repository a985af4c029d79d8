"""Labelled rows for fitting, and what the classifiers share.

Models are fitted on the driver, in numpy, on a bounded sample: at most ``per_class`` documents of each label, none
longer than ``longest`` bytes, taken in an order given by a hash of doc_id. The bounds are parameters of the operators
and do not grow with the tables. Scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.text import Words, split, utf8


@dataclass(frozen=True)
class Sample:
    """Whole texts, one after the other, and the label (0 or 1) of each."""

    data: np.ndarray
    offsets: np.ndarray
    label: np.ndarray

    def words(self, **options) -> Words:
        return split(self.data, self.offsets, **options)

    def lots(self, texts: int = 64) -> Iterator[tuple[int, Sample]]:
        """Parts of the sample and the place of their first text, to keep the driver's memory low."""
        for low in range(0, len(self.label), texts):
            high = min(low + texts, len(self.label))
            first, end = self.offsets[low], self.offsets[high]
            yield low, Sample(self.data[first:end], self.offsets[low:high + 1] - first, self.label[low:high])

    @property
    def usable(self) -> bool:
        return bool((self.label == 0).any() and (self.label == 1).any())

    @property
    def prior(self) -> float:
        """The score of everything where the sample doesn't have both labels."""
        return float(self.label.mean()) if len(self.label) else 0.5


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; NULL for NULL."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None, per_class: int,
                    longest: int) -> Sample:
    """Rows of ``docs`` (doc_id, text) with a label.

    Labels other than 0 and 1, labels of a NULL doc_id and doc_ids with contradicting labels are left out; a repeated
    document counts as often as it stands there. ``usable`` restricts the labels, as a condition on ``doc_id``.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("_label"))
    if usable is not None:
        known = known.filter(usable)
    known = (known.filter(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
             .filter(F.col("_label") == F.col("_other")).withColumn("_order", F.md5(F.col("doc_id").cast("string"))))
    short = docs.select(F.col("doc_id"), F.octet_length(utf8("text")).alias("_size")).filter(F.col("_size") <= longest)
    known = known.join(short, "doc_id", "left_semi")  # only labels with a text to fit on count towards the bound
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("_label") == value).orderBy("_order").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (docs.select(F.col("doc_id"), utf8("text").alias("_text")).filter(F.octet_length("_text") <= longest)
            .join(F.broadcast(chosen.drop("_other")), "doc_id")  # at most 2 * per_class short rows
            .select("_text", "_label", "_order"))
    found = []
    for value in (0, 1):
        found += rows.filter(F.col("_label") == value).orderBy("_order", "_text").limit(per_class).collect()
    found.sort(key=lambda r: (r["_order"], bytes(r["_text"])))
    texts = [bytes(r["_text"]) for r in found]
    return Sample(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]).astype(np.int64),
                  np.array([r["_label"] for r in found], np.int64))


def with_excerpts(sample: Sample, below: int, seed: int) -> Sample:
    """The sample and fewer than ``below`` words from the middle of each text, so that a fit knows short texts too."""
    words, rng = sample.words(lower=False), np.random.Generator(np.random.PCG64(seed))
    raw = sample.data.tobytes()
    texts, label = [raw], [sample.label]
    for n in np.flatnonzero(words.counts >= below):
        first = words.first[n] + int(words.counts[n] * rng.uniform(0.25, 0.7))
        last = min(first + int(rng.integers(1, below)), words.first[n + 1]) - 1
        texts.append(raw[words.start[first]:words.end[last]])
        label.append(sample.label[n:n + 1])
    more = np.cumsum([len(raw)] + [len(t) for t in texts[1:]])[1:]
    return Sample(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([sample.offsets, more]).astype(np.int64),
                  np.concatenate(label))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps for a dict of dense arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for name, g in gradients.items():
            self.mean[name] += 0.1 * (g - self.mean[name])
            self.square[name] += 0.001 * (g * g - self.square[name])
            self.weights[name] -= (rate * self.mean[name] / (np.sqrt(self.square[name]) + 1e-8)).astype(g.dtype)
