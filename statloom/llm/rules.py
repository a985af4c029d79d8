"""Quality rules: counted properties of a text, and a calibrated logistic regression over hashed words and n-grams.

The counts come from exact comparisons of lines and word windows within a text. The model reads the shares of
hashed words and of byte n-grams; its raw outputs are calibrated to probabilities on documents left out of the fit, and
a fixed threshold decides. Everything is computed per Arrow batch over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from statloom.llm.fitting import Adam, Sample, labelled_sample, sigmoid, with_excerpts
from statloom.llm.text import SliceHash, Words, binary_parts, map_texts, mix64, split

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RulesPlan:
    fewest_words: int = 10
    most_repeated: int = 20     # percent of the words
    window: int = 5             # words
    threshold: float = 0.3      # a document stays from this probability of label 1
    buckets: int = 2048         # of words, and as many of n-grams
    grams: tuple[int, ...] = (2, 3, 4)
    excerpt: int = 40           # words that excerpts for training stay below
    epochs: int = 40
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-5
    per_class: int = 1000       # labelled documents of each label that the fit may use
    longest: int = 12_000       # bytes of the longest of them
    seed: int = 3


@dataclass(frozen=True)
class RulesModel:
    """Bucket weights (words, then n-grams), and the calibration: probability = sigmoid(slope * raw + shift)."""

    plan: RulesPlan
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _twins(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one of the same owner, and which stand behind an earlier one."""
    order = np.lexsort((value, owner))  # stable, so the earliest of equals comes first
    same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twin, later = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:]] = same
    twin[order[1:]] = same
    twin[order[:-1]] |= same
    return twin, later


def counts(words: Words, plan: RulesPlan) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text of a chunk, which must not be lower-cased."""
    data, offsets, text_of = words.data, words.offsets, words.text_of
    starts_char = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char, dtype=np.int64)])
    n_texts = len(words.counts)
    word_chars = np.bincount(text_of, chars[words.end] - chars[words.start], n_texts).astype(np.int64)

    slices = SliceHash(data)
    breaks = np.flatnonzero(data == 0x0A)
    filled = offsets[:-1][np.diff(offsets) > 0]
    start = np.union1d(filled, breaks + 1)
    start = start[start < len(data)]
    # a line ends at its break or with its text; the next start is one of the two
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A)) if len(start) else end
    with_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[with_word], end[with_word]
    line_text = np.searchsorted(offsets, start, side="right") - 1
    _, later = _twins(line_text, slices(start, end))
    dup_lines = np.bincount(line_text[later], minlength=n_texts)

    hashes, size = slices(words.start, words.end), plan.window
    windows = np.arange(max(0, len(hashes) - size + 1))
    windows = windows[text_of[windows] == text_of[windows + size - 1]] if len(windows) else windows
    value = np.zeros(len(windows), np.uint64)
    for n in range(size):
        value = mix64(value * np.uint64(0x9DDFEA08EB382D69) + hashes[windows + n])
    twin, _ = _twins(text_of[windows], value)
    change = np.zeros(len(hashes) + 1, np.int64)
    change[windows[twin]] += 1
    change[windows[twin] + size] -= 1  # windows start at different words, so each place is met once
    repeated = np.cumsum(change)[:-1] > 0
    return {"n_words": words.counts.astype(np.int64), "word_chars": word_chars,
            "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": dup_lines.astype(np.int64),
            "n_repeat_words": np.bincount(text_of[repeated], minlength=n_texts).astype(np.int64)}


def failed(found: dict[str, np.ndarray], plan: RulesPlan) -> np.ndarray:
    """Texts that the counted rules reject."""
    return ((found["n_words"] < plan.fewest_words)
            | (100 * found["n_repeat_words"] > plan.most_repeated * found["n_words"]))


def _features(words: Words, plan: RulesPlan) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Buckets and their texts, for words and for n-grams of each size, and how many each text has."""
    slices, half = SliceHash(words.data), np.uint64(plan.buckets)
    found = [((slices(words.start, words.end) % half).astype(np.int64), words.text_of)]
    text = np.repeat(np.arange(len(words.counts)), np.diff(words.offsets))
    at = np.arange(len(words.data))
    for size in plan.grams:
        begin = at[:max(0, len(at) - size + 1)]
        begin = begin[text[begin] == text[begin + size - 1]]
        found.append(((slices(begin, begin + size) % half).astype(np.int64) + plan.buckets, text[begin]))
    return found, [np.bincount(owner, minlength=len(words.counts)) for _, owner in found]


def _matrix(sample: Sample, plan: RulesPlan) -> np.ndarray:
    """Shares of buckets, a row per text; made some texts at a time."""
    x = np.zeros((len(sample.label), 2 * plan.buckets), np.float32)
    for low, some in sample.lots():
        rows = len(some.label)
        for (bucket, owner), held in zip(*_features(some.words(lower=False), plan)):
            share = 1.0 / np.maximum(held, 1)
            x[low:low + rows] += np.bincount(owner * x.shape[1] + bucket, share[owner], rows * x.shape[1]).reshape(rows, -1)
    return x


def _raw(weight: np.ndarray, bias: float, words: Words, plan: RulesPlan) -> np.ndarray:
    out = np.full(len(words.counts), bias)
    for (bucket, owner), held in zip(*_features(words, plan)):
        out += np.bincount(owner, weight[bucket], len(out)) / np.maximum(held, 1)
    return out


def probabilities(model: RulesModel, words: Words) -> np.ndarray:
    return sigmoid(model.slope * _raw(model.weight, model.bias, words, model.plan) + model.shift)


def _calibration(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the log-likelihood, with targets drawn in from 0 and 1."""
    ones, zeros = int((label == 1).sum()), int((label == 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    middle, spread = raw.mean(), raw.std() + 1e-9
    x = np.stack([(raw - middle) / spread, np.ones(len(raw))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ at)
        at = at - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * at)
    return float(at[0] / spread), float(at[1] - at[0] * middle / spread)


def fit(sample: Sample, plan: RulesPlan = RulesPlan()) -> RulesModel:
    """A calibrated model; without both labels every text gets the sample's share of label 1."""
    if not sample.usable:
        odds = np.clip(sample.prior, 1e-6, 1 - 1e-6)
        return RulesModel(plan, np.zeros(2 * plan.buckets), 0.0, 1.0, float(np.log(odds / (1 - odds))))
    sample = with_excerpts(sample, plan.excerpt, plan.seed)
    x = _matrix(sample, plan)
    aside = np.arange(len(x)) % 4 == 3  # for calibration
    mine, label = np.flatnonzero(~aside), sample.label
    scale = 1.0 / (np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - x.mean(0) ** 2, 0)) + 1e-3)
    w = {"weight": np.zeros(x.shape[1], np.float32), "bias": np.zeros(1, np.float32)}
    learned, rng = Adam(w, plan.rate), np.random.Generator(np.random.PCG64(plan.seed))
    for _ in range(plan.epochs):
        order = rng.permutation(mine)
        for lot in range(0, len(order), plan.batch):
            some = order[lot:lot + plan.batch]
            given = x[some] * scale
            wrong = ((sigmoid(given @ w["weight"] + w["bias"]) - label[some]) / len(some)).astype(np.float32)
            learned.step({"weight": (given.T @ wrong + plan.decay * w["weight"]).astype(np.float32),
                          "bias": wrong.sum(keepdims=True)})
    weight, bias = (w["weight"] * scale).astype(np.float64), float(w["bias"][0])
    slope, shift = _calibration(x[aside] @ weight + bias, label[aside])
    return RulesModel(plan, weight, bias, slope, shift)


def fit_from(docs: DataFrame, labels: DataFrame, usable: Column | None = None, plan: RulesPlan = RulesPlan()) -> RulesModel:
    return fit(labelled_sample(docs, labels, "quality", usable, plan.per_class, plan.longest), plan)


def apply_rules(docs: DataFrame, model: RulesModel) -> DataFrame:
    """The columns of ``docs`` and ``COUNTS``, ``base_failed``, ``quality`` (a probability) and ``kept``.

    Columns with these names are replaced. NULL, empty and blank texts have no words and so fail. Every row is judged by
    itself, so repeated rows get the same verdict.
    """
    plan = model.plan

    def compute(texts: pa.Array) -> list:
        words = split(*binary_parts(texts), lower=False)
        found = counts(words, plan)
        bad, quality = failed(found, plan), probabilities(model, words)
        return [*(found[c] for c in COUNTS), bad, quality, ~bad & (quality >= plan.threshold)]

    added = {name: "long" for name in COUNTS} | {"base_failed": "boolean", "quality": "double", "kept": "boolean"}
    return map_texts(docs, added, compute)
