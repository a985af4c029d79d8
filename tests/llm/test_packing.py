"""Tokens against the tokenizer, pieces and places against their definition."""

import random
import zlib
from collections import defaultdict

import numpy as np

from statloom.llm import packing, tokens
from statloom.llm.tokens import Encoder


def encode(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, before = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])]


def test_ids_equal_the_tokenizers(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "a  b", "\n\nx", "a\n", "a <|endoftext|> b<|endoftext|>", "don't  stop\tit", "x y z", "a　 b", "1 2\n3 #$%", "é ü\nñ",
             "日本 語 “q” x", "a\x85b c", "don't we'll\nI'm", "x", "᠎a b", "a\x1cb"]
    texts += ["".join(rng.choice(["ab", "C", "é", " ", " ", "\n", "'s", "12", "#", "ß", "\xa0", "中"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    encoder = Encoder()
    want = [x.tolist() for x in encoder._whole(texts)]
    assert encode(encoder, texts) == want and encode(encoder, texts) == want
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    few = Encoder()
    assert encode(few, texts) == want and encode(few, texts[::-1]) == want[::-1] and len(few.keys) == 50
    few.ranks = None  # the tokenizer alone
    assert encode(few, texts) == want


def test_sum_of_squares_takes_the_least_place():
    rng = random.Random(5)
    lengths, capacity = [rng.randrange(1, 31) for _ in range(300)], 30
    chosen, offset = packing.sum_of_squares(np.array(lengths), capacity)
    gaps: dict[int, int] = {}
    for size, sequence, place in zip(lengths, chosen.tolist(), offset.tolist()):
        able = {s: g for s, g in gaps.items() if g >= size}

        def squares(at):
            after = {**gaps, at: gaps[at] - size}
            counts = defaultdict(int)
            for g in after.values():
                counts[g] += g > 0
            return sum(c * c for c in counts.values())

        if able:
            assert sequence in able and squares(sequence) == min(map(squares, able))
        else:
            assert sequence not in gaps
            gaps[sequence] = capacity
        assert place == capacity - gaps[sequence]
        gaps[sequence] -= size
    assert len(gaps) <= 1.1 * sum(lengths) / capacity + 1


def test_pack(spark, odd, small_dir):
    for docs, capacity in ((spark.read.parquet(f"{small_dir}/documents.parquet"), 2048), (odd, 64)):
        given = docs.select("doc_id", "text").collect()
        rows = packing.pack(docs, capacity, with_ids=True).collect()
        whole = [[*x.tolist(), 0] for x in Encoder()._whole([r.text or "" for r in given])]
        want = defaultdict(int)
        for r, ids in zip(given, whole):
            first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids), capacity), len(ids)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[r.doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        got, sequences = defaultdict(int), defaultdict(list)
        for r in rows:
            got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
            sequences[r.sequence_id].append((r.offset, r.length))
        assert got == want
        for places in sequences.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
        total = sum(map(len, whole))
        assert len(sequences) <= total / capacity * 1.02 + 2
    made = packing.sequences(odd, 64).collect()
    assert sum(r.length for r in made) == total == sum(len(bytes(r.ids)) // 4 for r in made)
    assert packing.pack(odd.limit(0)).count() == 0


def test_other_tasks_of_a_worker_drop_the_encoder():
    from statloom.llm.text import chunks
    from statloom.llm.tokens import encoder
    kept = encoder(None)
    assert list(chunks(iter([]), "text", keep=encoder)) == [] and encoder(None) is kept
    assert list(chunks(iter([]), "text")) == [] and encoder.cache_info().currsize == 0
