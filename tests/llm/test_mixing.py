"""Mixing: budgets, targets, order, and the rows that every operator must take."""

from collections import Counter, defaultdict

from statloom.llm import mixing


def test_targets_share_out_what_full_sources_leave(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 1000), ("n", 0)], "_source string, _size long")
    got = {r["_source"]: (r.source_size, r.target) for r in mixing.source_targets(sizes, mixing.MixPlan()).collect()}
    # a (weight 3) and b (weight 1), c (weight 2), NULL (weight 3): a and NULL are full, the rest of 3015 goes 1 : 2
    assert got["sa"] == (10, 20.0) and got["n"] == (0, 0.0)
    assert abs(got["sc"][1] - 1996.6666666666667) < 1e-9 and abs(got["sb"][1] - 998.3333333333334) < 1e-9


def test_mix_equals_takes_and_is_ordered(spark):
    rows = [(n, "w " * (n % 17 + 1), "abc"[n % 3]) for n in range(300)] + [(300, None, None), (301, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    takes = mixing.mix_takes(docs).collect()
    assert len(takes) == len(rows)
    words = Counter()
    for r in takes:
        assert r.taken in (0, r.size, 2 * r.size)
    copies = mixing.mix(docs).collect()
    for r in copies:
        words[r.doc_id] += len(r.text.split())
    assert {r.doc_id: r.taken for r in takes if r.taken} == dict(words)
    assert sum(words.values()) <= 1.5 * sum(r.size for r in takes)
    by_source, target = defaultdict(int), {}
    sources = {r[0]: r[2] for r in rows}
    for r in takes:
        by_source[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(by_source[s] - target[s]) <= 40 for s in target)
    # in the merged order every source is near its share at any point
    seen, total = Counter(), 0
    for r in copies:
        seen[r.source] += len(r.text.split())
        total += len(r.text.split())
        if total > 300:
            for s in "abc":
                assert abs(seen[s] / total - target[s] / sum(target.values())) < 0.15
    assert sorted(map(tuple, mixing.mix_takes(docs.repartition(7)).collect())) == sorted(map(tuple, takes))


def test_odd_rows(odd):
    rows = mixing.mix_takes(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() > 3
    assert mixing.mix_takes(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0
