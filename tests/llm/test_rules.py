"""Counted rules against brute force; the verdict on labelled rows."""

import collections
import random
import re

import numpy as np

from statloom.llm import rules
from statloom.llm.text import split

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words, seen, again = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    texts = ["", "\n", " \n\n a\n a\na\n", "é é é é é é\né", "x\ny\nx\r\nx", "\n\nq\nq", "a b c d e a b c d e", "#|<>& x　y\x85z \x0b\x0ct"]
    texts += ["".join(rng.choice("ab \n\té#") for _ in range(rng.randrange(60))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    words = split(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]).astype(np.int64), lower=False)
    found = rules.counts(words, rules.RulesPlan())
    assert list(zip(*(found[c].tolist() for c in rules.COUNTS))) == [brute(t) for t in texts]


def test_verdicts(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.apply_rules(docs, rules.fit_from(docs, labels)).join(labels.select("doc_id"), "doc_id").collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = {q: np.mean([r.kept for r in rows if label[r.doc_id] == q and r.n_words >= 10]) for q in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.15
    assert all(not r.kept for r in rows if r.base_failed)


def test_odd_rows(odd, some_labels):
    rows = rules.apply_rules(odd, rules.fit_from(odd, some_labels)).collect()
    assert len(rows) == odd.count() and all(r.base_failed for r in rows if r.n_words < 10)
    unlabelled = rules.fit_from(odd, some_labels.limit(0))
    assert {r.quality for r in rules.apply_rules(odd, unlabelled).collect()} == {0.5}
    assert rules.apply_rules(odd.limit(0), unlabelled).count() == 0
