"""License scans against brute force over every window and every position."""

import random
import re

from statloom.llm import licenses

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def brute(text, plan=licenses.LicensePlan()):
    words = words_of(text)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = words_of(phrase)
        for n in range(len(words) - len(p) + 1):
            if words[n:n + len(p)] == p:
                places.append(n)
                base.add(label)
    for label, template in plan.templates:
        t, width = set(words_of(template)), 2 * len(words_of(template))
        for begin in range(0, len(words), width // 2):
            common = len(t & set(words[begin:begin + width]))
            if 100 * common >= plan.percent * len(t):
                labels.add(label)
                score = max(score, common / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else score)


def test_scan_equals_brute_force(spark):
    rng = random.Random(9)
    filler = "the of license under version general public software mit cc by é copy Notice permission any 2 0 3 foo bar".split()
    texts = [None, "", " - ", "MIT license", "mit\nLICENSE mit license", "cc by cc-by CC_BY", "gnu general public", "xmit license"]
    for n in range(400):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 60))]
        if n % 2:
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 6)):
                notice.pop(rng.randrange(len(notice))) if len(notice) > 1 and rng.random() < .5 else notice.insert(
                    rng.randrange(len(notice) + 1), rng.choice(filler))
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(rng.choice((" ", "\n", ", ")).join(words))
    texts.append("word " * 30_000 + licenses.TEMPLATES[1][1])
    rows = list(enumerate(texts)) + [(None, texts[20]), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, labels int").repartition(3)
    got = sorted([(r.doc_id if r.doc_id is not None else -1, *r[1:8]) for r in licenses.scan(docs).collect()], key=str)
    assert got == sorted([(i if i is not None else -1, *brute(t)) for i, t in rows], key=str)
    assert sum(bool(r[6]) for r in got) > 100
    assert licenses.scan(docs.limit(0)).count() == 0
