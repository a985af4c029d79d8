"""License blocks that start anywhere, against brute force over every start."""

import random

from statloom.llm import licenses
from test_licenses import words_of


def brute(text, plan):
    words, blocks = words_of(text), []
    for n, (label, template) in enumerate(plan.templates):
        must = set(words_of(plan.obligatory[n])) if plan.obligatory else set()
        t, width, mine = set(words_of(template)), 2 * len(words_of(template)), []
        for begin in range(len(words)):
            end = min(begin + width, len(words))
            common = len(t & set(words[begin:end]))
            if 100 * common < plan.percent * len(t) or not must <= set(words[begin:end]):
                continue
            if mine and begin <= mine[-1][2]:
                mine[-1][2:] = end - 1, max(mine[-1][3], common / len(t))
            else:
                mine.append([label, begin, end - 1, common / len(t)])
        blocks += map(tuple, mine)
    return sorted(blocks)


def scanned(spark, texts, plan):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in licenses.scan(docs, plan).collect()}


def test_blocks_equal_brute_force_over_every_start(spark):
    rng = random.Random(19)
    filler = "the of license under version general public software mit cc by é copy Notice permission any 2 0 3 foo bar".split()
    texts = [None, "", " - "]
    for n in range(300):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 90))]
        for _ in range(n % 3):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 9)):
                notice.insert(rng.randrange(len(notice) + 1), rng.choice(filler))
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words))
    texts.append("word " * 30_000 + licenses.TEMPLATES[1][1])
    rows = scanned(spark, texts, licenses.WHOLE)
    for n, text in enumerate(texts):
        want = brute(text, licenses.WHOLE)
        assert sorted(map(tuple, rows[n].blocks or [])) == want
        assert rows[n].score == (1.0 if rows[n].n_base else max((b[3] for b in want), default=0.0))
    assert sum(bool(r.blocks) for r in rows.values()) > 100


def test_notice_is_found_at_any_offset(spark, tmp_path):
    from statloom.llm.queries import QUERIES
    bsd = dict(licenses.TEMPLATES)["bsd"].split()
    notice = " ".join(bsd[:10] + [f"line{n}" for n in range(10)] + bsd[10:])
    texts = ["word " * n + notice + " word" * 30 for n in range(21)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()
    assert [(r.labels, r.score) for r in rows] == [("bsd", 1.0)] * 21


def test_notice_of_another_license_gets_no_label(spark):
    near = ["Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "released under the Apache License", "released under the BSD License",
            "licensed under the Mozilla License, version 2.0", "This work is licensed under the GNU General Public License, version 2.",
            "This work is licensed under a Creative Commons Attribution 3.0 International License.",
            "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in "
            "compliance with the License. You may obtain a copy of the License at"]
    own = [text for _, text in licenses.TEMPLATES]
    rows = scanned(spark, [f"some words {t} more words" for t in near + own], licenses.WHOLE)
    assert [rows[n].blocks for n in range(len(near))] == [None] * len(near)
    for n, (label, _) in enumerate(licenses.TEMPLATES, len(near)):
        assert label in {b.label for b in rows[n].blocks} and max(b.containment for b in rows[n].blocks) == 1.0


def test_windows_by_step_hold_obligatory_tokens_too(spark):
    rows = scanned(spark, ["Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0"], licenses.LicensePlan(obligatory=licenses.IDENTIFYING))
    assert [rows[0].blocks, rows[1].blocks[0].label] == [None, "cc-by-nc-4.0"]


def test_ordinary_texts_with_words_of_a_short_notice_get_no_label(spark):
    texts = ["the dataset that MIT researchers released under the agreement", "a license that MIT gave under the treaty",
             "Apache helicopter, version 2.0, was licensed under the treaty", "under CC and also by NC, licensed 4 times",
             "the GNU project works in general with the public, version 3, this is under work"]
    rows = scanned(spark, texts, licenses.WHOLE)
    assert [(rows[n].labels, rows[n].blocks) for n in range(len(texts))] == [("", None)] * len(texts)
    short = ["Licensed under Apache License, Version 2.0", "Released under a MIT License", "licensed, CC BY-NC 4.0"]
    rows = scanned(spark, short, licenses.WHOLE)
    assert [{b.label for b in rows[n].blocks or ()} for n in range(3)] == [{"apache-2.0"}, {"mit"}, {"cc-by-nc-4.0"}]
