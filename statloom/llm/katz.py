"""Language-model scores by Katz backoff over word pairs.

A token after its history ``h`` has ``P(w|h) = d(c) * c / (c(h) + 1)`` for a pair seen ``c`` times, with Good-Turing
discounts ``d``, and otherwise ``alpha(h) * P(w)``; ``P(w)`` is built the same way over single tokens, and what it
leaves goes to the unknown token. ``alpha(h)`` is the mass left by h's discounted pairs over the unigram mass of the
tokens not seen after h, so every history sums to 1 exactly. The one in ``c(h) + 1`` keeps some mass for backoff
where no count is discounted.

How it is spread out: token counts are a table partitioned by word. The most frequent tokens, a bounded number, are
broadcast with their counts; all others are looked up by joins. Token pairs are dealt out by history, packed by chunk
and bucket, a frequent history over several buckets; the number of buckets follows the tokens, so that
each holds about as many at any size. Frequent pairs, a bounded number, are found from counts per chunk beforehand: a
bucket gets their counts by chunk only, and their occurrences stay with the chunk until the counts are known and
broadcast. A bucket counts its pairs and turns every occurrence into sums per document;
as discounts are known only at the end, it keeps how many tokens met a pair count of 1, 2, … rather than their
logarithms. Backoff weights are a table by history, made of sums over buckets, and joined to the unseen pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.subwords import ragged
from statloom.llm.text import binary_parts, chunks, mix64, utf8, words_of
from statloom.llm.work import stored

SMALL = 5  # counts up to this one are discounted
_TAIL = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class KatzPlan:
    head: int = 1 << 19               # most tokens that are broadcast
    bucket_tokens: int = 1_200_000    # token pairs in a bucket
    split_tokens: int = 300_000       # a history with more is dealt over several buckets; a pair with more stays with its chunks
    least_buckets: int = 8


def discounts(counted: dict[int, int]) -> list[float]:
    """Good-Turing factors for the counts 1 to ``SMALL``, from how many types have each count.

    Where the formula has no value in (0, 1), as in small corpora, half a count is taken off.
    """
    n = [counted.get(r, 0) for r in range(SMALL + 2)]
    out = []
    for r in range(1, SMALL + 1):
        value = -1.0
        if n[1] and n[r] and n[SMALL + 1]:
            beyond = (SMALL + 1) * n[SMALL + 1] / n[1]
            if beyond < 1:
                value = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
        out.append(value if 0 < value < 1 else (r - 0.5) / r)
    return out


@dataclass(frozen=True)
class Unigrams:
    """All of the token level that has a bounded size. Codes: head tokens by position, then the end and the start."""

    words: np.ndarray      # hashes of the head tokens, sorted
    counts: np.ndarray     # their training counts, then those of the end and of the start
    tokens: int            # N
    types: int             # V
    factor: tuple[float, ...]
    unknown: float         # probability of the unknown token

    @property
    def end(self) -> int:
        return len(self.words)

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        factor = np.array([1.0, *self.factor, 1.0])[np.minimum(counts, SMALL + 1)]
        with np.errstate(divide="ignore"):
            known = np.log10(factor * counts / (self.tokens + 1))
        return np.where(counts > 0, known, math.log10(self.unknown))


def _count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts; a task adds up its chunks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for chunk in chunks(batches, "_bytes"):
            new, times = np.unique(words_of(chunk, "_bytes").hashes(), return_counts=True)
            both, place = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(both)).astype(np.int64)
            words = both
            if len(words) > 400_000:
                yield out()
                words, counts = words[:0], counts[:0]
        if len(words):
            yield out()

    return (texts.select(utf8("text").alias("_bytes")).mapInArrow(run, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _unigrams(table: DataFrame, documents: int, plan: KatzPlan) -> Unigrams:
    """``documents``: how many the model learns from, which is the count of the end token."""
    by_count = table.groupBy("n").agg(F.count(F.lit(1)).alias("types"))
    small = {r["n"]: r["types"] for r in by_count.filter(F.col("n") <= SMALL + 1).collect()}
    if documents:
        small[documents] = small.get(documents, 0) + 1
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = total[0] + documents, total[1] + (documents > 0)
    factor = discounts(small)
    left = 1 + sum((1 - d) * r * small.get(r, 0) for r, d in enumerate(factor, 1))
    bound = 1
    if total[1] > plan.head:  # the least count whose words, with all of higher counts, are few enough
        levels = by_count.select(F.floor(F.log2("n")).alias("level"), "types").groupBy("level").agg(F.sum("types").alias("types"))
        kept, bound = 0, None
        for level, held in sorted(((r["level"], r["types"]) for r in levels.collect()), reverse=True):
            if kept + held > plan.head:
                inside = by_count.filter(F.floor(F.log2("n")) == level)
                # halve the interval of counts until what is above fits
                low, high = 2 ** level, 2 ** (level + 1)
                while low < high:
                    middle = (low + high) // 2
                    above = inside.filter(F.col("n") >= middle).agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
                    low, high = (low, middle) if kept + above <= plan.head else (middle + 1, high)
                bound = low
                break
            kept += held
    head = table.filter(F.col("n") >= bound).toArrow()
    words = head.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    counts = np.concatenate([head.column("n").to_numpy()[order], [documents, documents]]).astype(np.int64)
    return Unigrams(words[order], counts, tokens, types, tuple(factor), left / (tokens + 1))


@dataclass(frozen=True)
class _Pairs:
    """The token pairs of a chunk: codes of 32 bits, and of 64 with the hash of tokens beyond the head."""

    counts: np.ndarray
    text: np.ndarray
    history: np.ndarray
    token: np.ndarray
    full_history: np.ndarray
    full: np.ndarray

    @property
    def key(self) -> np.ndarray:
        """A hash of each pair."""
        return mix64(self.full_history * np.uint64(0x9DDFEA08EB382D69) + mix64(self.full))


def _pairs(chunk: pa.RecordBatch, uni: Unigrams) -> _Pairs:
    end, start = np.uint32(uni.end), np.uint32(uni.end + 1)
    words = words_of(chunk, "_bytes")
    hashes, counts = words.hashes(), words.counts
    at = np.searchsorted(uni.words, hashes)
    known = at < len(uni.words)
    known[known] = uni.words[at[known]] == hashes[known]
    code = np.where(known, at, _TAIL).astype(np.uint32)
    texts, total = len(counts), len(code) + len(counts)
    last = np.cumsum(counts + 1) - 1             # places of the end tokens
    inner = np.ones(total, bool)
    inner[last] = False
    token, full = np.full(total, end, np.uint32), np.zeros(total, np.uint64)
    token[inner], full[inner] = code, np.where(known, at.astype(np.uint64), hashes | np.uint64(1 << 63))
    full[last] = end
    history, full_history = np.empty_like(token), np.empty_like(full)
    history[1:], full_history[1:] = token[:-1], full[:-1]
    opening = last - counts
    history[opening], full_history[opening] = start, start
    return _Pairs(counts, np.repeat(np.arange(texts, dtype=np.uint32), counts + 1), history, token, full_history, full)


def _frequent(docs: DataFrame, size: int, model, plan: KatzPlan) -> np.ndarray:
    """Hashes of all pairs with ``split_tokens`` occurrences, and of some with at least half as many.

    A chunk leaves out its pairs with less than its share, by bytes of ``size``, of half that number; over all chunks this is
    less than half of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for chunk in chunks(batches, "_bytes"):
            # an end of a text counts as a byte, so texts without words have their share
            share = (binary_parts(chunk.column(chunk.schema.get_field_index("_bytes")))[1][-1] + chunk.num_rows) / size
            new, times = np.unique(_pairs(chunk, model.value).key, return_counts=True)
            kept = times >= share * plan.split_tokens / 2
            keys, place = np.unique(np.concatenate([keys, new[kept]]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times[kept]]), len(keys)).astype(np.int64)
            if len(keys) > 400_000:
                yield out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    found = (docs.select("_bytes").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= plan.split_tokens / 2).select("key").toArrow())  # at most 2 / split_tokens of all pairs
    return np.sort(found.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _is_in(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in ``some``, sorted."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _dealt(docs: DataFrame, model, frequent, buckets: int, plan: KatzPlan) -> DataFrame:
    """Token pairs packed per chunk and bucket, with bucket -1 - n the rows of ``docs`` themselves and frequent pairs.

    Of a frequent pair, a bucket gets the count in the training texts of the chunk, in rows with a ``base`` of -1; where it
    stands goes with the documents, in rows with a size above 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = model.value
        zstd = pa.Codec("zstd", 1)
        parts = (uni.counts // plan.split_tokens + 1).astype(np.uint64)
        base = TaskContext.get().partitionId() << 40
        logs = np.log10(uni.counts + 1.0)
        for chunk in chunks(batches, "_bytes"):
            pairs = _pairs(chunk, uni)
            counts, text, history, token = pairs.counts, pairs.text, pairs.history, pairs.token
            full_history, full = pairs.full_history, pairs.full
            texts, total = len(counts), len(token)
            train = chunk.column("train").to_numpy(zero_copy_only=False)

            ways = np.ones(total, np.uint64)
            listed = history != _TAIL
            ways[listed] = parts[history[listed]]
            key = mix64(full_history * np.uint64(0x9DDFEA08EB382D69) + mix64(full) % ways)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            ids = pairs.key
            stays = _is_in(ids, frequent.value)
            rows: list[tuple] = []

            def pack(places: np.ndarray, first: np.ndarray, base: int, bits: bytes) -> None:
                """A row per bucket with the pairs at ``places``, each after a number of ``first``."""
                of = bucket[places]
                order = np.argsort(of.astype(np.uint16) if buckets < 65536 else of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(buckets + 1))
                for n in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[n]:edges[n + 1]]
                    some = places[own]
                    h, w = history[some], token[some]
                    tails = np.concatenate([full_history[some][h == _TAIL], full[some][w == _TAIL]])
                    raw = b"".join([first[own].tobytes(), h.tobytes(), w.tobytes(), tails.tobytes()])
                    rows.append((n, base, len(some), len(raw), zstd.compress(raw, asbytes=True), bits))

            goes = np.flatnonzero(~stays)
            pack(goes, text[goes], base, np.packbits(train).tobytes())
            held = np.flatnonzero(stays)
            if len(held):
                _, place, which = np.unique(ids[held], return_index=True, return_inverse=True)
                pack(held[place], np.bincount(which, train[text[held]], len(place)).astype(np.uint32), -1, b"")
                both, times = np.unique(text[held].astype(np.int64) * len(place) + which, return_counts=True)
                raw = b"".join([(both // len(place)).astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes(),
                                ids[held[place[both % len(place)]]].tobytes()])
                rows.append((-1 - (base + rows_hash(base, texts)) % buckets, base, len(both), len(raw),
                             zstd.compress(raw, asbytes=True), b""))
            # of the documents: tokens, and of those in the head how many are known and their part of the base score
            in_head = token != _TAIL
            seen = in_head.copy()
            seen[in_head] = uni.counts[token[in_head]] > 0
            part = np.zeros(total)
            part[in_head] = logs[token[in_head]]
            table = pa.table({"doc_id": chunk.column("doc_id"), "train": chunk.column("train"), "n_tokens": counts + 1,
                              "n_known": np.bincount(text[seen], minlength=texts),
                              "base": np.bincount(text, part, texts)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            rows.append((-1 - (base + rows_hash(base, texts)) % buckets, base, texts, 0, sink.getvalue().to_pybytes(), b""))
            base += texts
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["bucket", "base", "n", "size", "packed", "train"])

    def rows_hash(base: int, texts: int) -> int:
        return (base * 2654435761 + texts) >> 7

    return docs.mapInArrow(run, "bucket int, base long, n long, size long, packed binary, train binary")


#: What a bucket finds, told apart by ``kind``; ``a`` and ``b`` are documents (row numbers), histories or tokens. The sums
#: of documents are packed by chunk, as almost every document has some in every bucket.
_FOUND = ("kind int, a long, b long, n long, sum double, base double, "
          + ", ".join(f"r{r} long" for r in range(1, SMALL + 2)) + ", packed binary")
DOCUMENT, SUMS, HISTORY, UNSEEN, RARE, RARE_PAIR, PAIRS, FREQUENT, PLACES = range(9)


def _found(kind: int, rows: int, **columns: np.ndarray) -> pa.Table:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = {"kind": pa.int32(), "sum": pa.float64(), "base": pa.float64(), "packed": pa.binary()}
    columns["kind"] = np.full(rows, kind)
    arrays = [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(rows, kinds.get(c, pa.int64()))
              for c in names]
    return pa.Table.from_arrays(arrays, names)


def _counted(dealt: DataFrame, model, plan: KatzPlan) -> DataFrame:
    """Counts and sums of every bucket, see ``_FOUND``."""
    def of_documents(table: pa.Table) -> pa.Table:
        parts = []
        for base, n, size, packed in zip(*(table.column(c).to_pylist() for c in ("base", "n", "size", "packed"))):
            if size:
                parts.append(_found(PLACES, 1, a=[base], n=[n], packed=[packed]))
                continue
            docs = pa.ipc.open_stream(packed).read_all()
            parts.append(_found(DOCUMENT, docs.num_rows, a=np.arange(docs.num_rows) + base,
                                b=docs.column("doc_id").combine_chunks(), n=docs.column("n_tokens").to_numpy(),
                                base=docs.column("base").to_numpy(), r1=docs.column("n_known").to_numpy(),
                                r2=docs.column("train").to_numpy().astype(np.int64)))
        return pa.concat_tables(parts)

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return of_documents(table)
        uni: Unigrams = model.value
        zstd = pa.Codec("zstd")
        total = int(table.column("n").to_numpy().sum())
        history, token = np.empty(total, np.uint64), np.empty(total, np.uint64)
        doc, train, at = np.empty(total, np.int32), np.empty(total, np.uint32), 0  # no document: -1
        documents, before = [], 0  # row numbers, and the place of a chunk's first document among them
        chunk_of, chunk_size = [], []
        for base, n, size, packed, bits in zip(*(table.column(c) for c in ("base", "n", "size", "packed", "train"))):
            n = n.as_py()
            raw = np.frombuffer(zstd.decompress(packed.as_buffer(), size.as_py()), np.uint8)
            text, h, w = (raw[4 * n * k:4 * n * (k + 1)].view(np.uint32) for k in range(3))
            tails, first = raw[12 * n:].view(np.uint64), int((h == _TAIL).sum())
            for codes, rare, out in ((h, tails[:first], history), (w, tails[first:], token)):
                out[at:at + n] = codes
                out[at:at + n][codes == _TAIL] = rare
            if base.as_py() < 0:  # a frequent pair's count
                doc[at:at + n], train[at:at + n] = -1, text
                at += n
                continue
            texts = int(text[-1]) + 1  # texts ascend within a chunk
            doc[at:at + n] = text.astype(np.int32) + before
            train[at:at + n] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8))[text]
            documents.append(base.as_py() + np.arange(texts))
            chunk_of.append(base.as_py())
            chunk_size.append(texts)
            before += texts
            at += n
        del table
        documents = np.concatenate([np.zeros(0, np.int64), *documents])

        order = np.argsort(mix64(history * np.uint64(0x9DDFEA08EB382D69) + token))
        history = history[order]  # one after the other, so that few copies stand at a time
        token = token[order]
        doc, train = doc[order], train[order]
        del order
        new = np.ones(total, bool)
        new[1:] = (history[1:] != history[:-1]) | (token[1:] != token[:-1])
        first = np.flatnonzero(new)
        pair = np.cumsum(new, dtype=np.int32) - 1
        count = np.add.reduceat(train, first, dtype=np.int64)
        pair_history, pair_token = history[first], token[first]
        del history, token, train, new
        own = np.flatnonzero(doc < 0)
        stays = np.unique(pair[own])  # frequent pairs
        if len(own):
            doc, pair = np.delete(doc, own), np.delete(pair, own)

        # histories of this bucket
        known, place = np.unique(pair_history, return_inverse=True)
        local = np.bincount(place, count, len(known)).astype(np.int64)
        listed = known < len(uni.counts)
        whole = local.copy()                                   # for a split history the head has the count
        whole[listed] = uni.counts[known[listed].astype(np.int64)]
        split = listed & (whole >= plan.split_tokens)

        rare = pair_token >= np.uint64(1 << 63)
        token_count = np.zeros(len(first), np.int64)
        token_count[~rare] = uni.counts[pair_token[~rare].astype(np.int64)]
        log_token = uni.log_probability(token_count)
        seen = count > 0
        log_pair = np.where(seen, np.log10(np.maximum(count, 1)) - np.log10(whole[place] + 1.0), np.where(rare, 0.0, log_token))
        backed = ~seen & (whole[place] > 0)

        # sums per document
        sums = [np.bincount(doc, log_pair[pair], len(documents))]
        for r in range(1, SMALL + 1):
            sums.append(np.bincount(doc[(count == r)[pair]], minlength=len(documents)).astype(np.float64))
        packed, low = [], 0
        for texts in chunk_size:
            packed.append(zstd.compress(np.stack([s[low:low + texts] for s in sums]).tobytes(), asbytes=True))
            low += texts
        parts = [_found(SUMS, len(packed), a=chunk_of, n=chunk_size, packed=packed)]
        del sums

        # unseen pairs, per document and history
        some = np.flatnonzero(backed[pair])
        if len(some):
            both, times = np.unique(doc[some].astype(np.int64) * len(known) + place[pair[some]], return_counts=True)
            parts.append(_found(UNSEEN, len(both), a=documents[both // len(known)], b=known[both % len(known)].view(np.int64), n=times))
        needed = np.zeros(len(known), bool)
        needed[place[pair[some]]] = True
        needed[place[stays[backed[stays]]]] = True
        needed |= split

        small = {f"r{r}": np.bincount(place[count == r], minlength=len(known))[needed] for r in range(1, SMALL + 1)}
        mass = np.bincount(place, np.where(seen & ~rare, 10.0 ** log_token, 0.0), len(known))[needed]
        parts.append(_found(HISTORY, int(needed.sum()), a=known[needed].view(np.int64), n=local[needed], sum=mass, **small))

        # tokens beyond the head: occurrences per document, and seen pairs of the histories above
        some = np.flatnonzero(rare[pair])
        parts.append(_found(RARE, len(some), a=documents[doc[some]], b=pair_token[pair[some]].view(np.int64), n=np.ones(len(some), np.int64),
                            r1=(~seen[pair[some]]).astype(np.int64)))
        some = np.flatnonzero(rare & seen & needed[place])
        parts.append(_found(RARE_PAIR, len(some), a=pair_history[some].view(np.int64), b=pair_token[some].view(np.int64)))
        if len(stays):
            h, w = pair_history[stays], pair_token[stays]
            parts.append(_found(FREQUENT, len(stays), a=h.view(np.int64), b=w.view(np.int64), n=count[stays], sum=log_pair[stays],
                                r1=backed[stays].astype(np.int64)))
        parts.append(_found(PAIRS, 1, **{f"r{r}": np.array([(count == r).sum()]) for r in range(1, SMALL + 2)}))
        return pa.concat_tables(parts)

    return dealt.groupBy("bucket").applyInArrow(run, _FOUND)


def _of_frequent(places: DataFrame, table: pa.Table) -> DataFrame:
    """What a bucket finds of its pairs' documents, for frequent pairs: ``table`` has them all, with their counts."""
    h, w = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in "ab")
    key = mix64(h * np.uint64(0x9DDFEA08EB382D69) + mix64(w))
    order = np.argsort(key)
    n, log, backed = (table.column(c).to_numpy()[order] for c in ("n", "sum", "r1"))
    known = places.sparkSession.sparkContext.broadcast((key[order], h[order], w[order], n, log, backed > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        key, history, token, count, log, backed = known.value
        for batch in batches:
            for base, n, packed in zip(*(batch.column(c) for c in range(3))):
                base, n = base.as_py(), n.as_py()
                raw = np.frombuffer(zstd.decompress(packed.as_buffer(), 16 * n), np.uint8)
                text, times = (raw[4 * n * k:4 * n * (k + 1)].view(np.uint32).astype(np.int64) for k in range(2))
                pair, texts = np.searchsorted(key, raw[8 * n:].view(np.uint64)), int(text[-1]) + 1
                sums = [np.bincount(text, times * log[pair], texts)]
                for r in range(1, SMALL + 1):
                    sums.append(np.bincount(text, times * (count[pair] == r), texts).astype(np.float64))
                parts = [_found(SUMS, 1, a=[base], n=[texts], packed=[zstd.compress(np.stack(sums).tobytes(), asbytes=True)])]
                some = np.flatnonzero(backed[pair])
                parts.append(_found(UNSEEN, len(some), a=base + text[some], b=history[pair[some]].view(np.int64), n=times[some]))
                some = np.flatnonzero(token[pair] >= np.uint64(1 << 63))
                parts.append(_found(RARE, len(some), a=base + text[some], b=token[pair[some]].view(np.int64), n=times[some],
                                    r1=times[some] * (count[pair[some]] == 0)))
                yield from pa.concat_tables(parts).to_batches()

    return places.select("a", "n", "packed").mapInArrow(run, _FOUND)


def _document_sums(packed: DataFrame) -> DataFrame:
    """``a, sum, r1, …`` per document, from the packed sums of all buckets; a group is a chunk of documents."""
    width = SMALL + 1

    def run(table: pa.Table) -> pa.Table:
        zstd = pa.Codec("zstd")
        sizes = table.column("n").to_pylist()
        total = np.zeros((width, max(sizes)))
        for n, held in zip(sizes, table.column("packed")):
            total[:, :n] += np.frombuffer(zstd.decompress(held.as_buffer(), 8 * width * n), np.float64).reshape(width, n)
        rows = table.column("a")[0].as_py() + np.arange(total.shape[1])
        return pa.table([pa.array(rows), pa.array(total[0]), *[pa.array(t.astype(np.int64)) for t in total[1:]]],
                        ["a", "sum", *[f"r{r}" for r in range(1, width)]])

    return packed.groupBy("a").applyInArrow(run, "a long, sum double, " + ", ".join(f"r{r} long" for r in range(1, width)))


def _log_unigram(n: Column, uni: Unigrams) -> Column:
    """The same as ``Unigrams.log_probability``, for a joined count (0 where unknown)."""
    factor = reduce(lambda rest, r: F.when(n == r, uni.factor[r - 1]).otherwise(rest), range(1, SMALL + 1), F.lit(1.0))
    return F.when(n > 0, F.log10(factor * n / F.lit(float(uni.tokens + 1)))).otherwise(math.log10(uni.unknown))


def katz_scores(docs: DataFrame, learn: Column, plan: KatzPlan = KatzPlan()) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs`` (doc_id, text).

    Tokens are the lower-cased words (A-Z only) and one end per document; ``learn``, a condition on ``doc_id``, tells
    what the model learns from (NULL: not). ``base_score`` is the add-one unigram score and ``score`` the model's,
    both as log10 probabilities of the whole text. A NULL or empty text is the end alone. Repeated rows are documents of
    their own, in training too. Without training rows every token is the unknown one and both scores are 0. Other
    columns are ignored. Words are told apart by a 63-bit hash.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                        F.coalesce(learn, F.lit(False)).alias("train"))
    learned = given.filter("train")
    table = stored(_count_words(learned), "tokens")
    model_ = _unigrams(table, learned.count(), plan)
    model = spark.sparkContext.broadcast(model_)  # at most plan.head tokens
    rows, size = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(utf8("text"))), F.lit(0))).first()
    tokens = model_.tokens * max(1.0, rows / max(1, int(model_.counts[-1])))
    buckets = max(plan.least_buckets, math.ceil(tokens / plan.bucket_tokens))
    prepared = given.select("doc_id", utf8("text").alias("_bytes"), "train")
    keys = _frequent(prepared, size + rows, model, plan)
    frequent = spark.sparkContext.broadcast(keys)  # at most 2 / split_tokens of all pairs
    found = stored(_counted(_dealt(prepared, model, frequent, buckets, plan), model, plan), "pairs", ("kind",))
    tables = [found]
    if len(keys):
        of_frequent = found.filter(F.col("kind") == FREQUENT).select("a", "b", "n", "sum", "r1").toArrow()
        tables.append(stored(_of_frequent(found.filter(F.col("kind") == PLACES), of_frequent), "frequent", ("kind",)))

    def of_kind(kind: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.filter(F.col("kind") == kind) for t in tables])

    small = [f"r{r}" for r in range(1, SMALL + 1)]
    pairs = of_kind(PAIRS).agg(*[F.sum(f"r{r}") for r in range(1, SMALL + 2)]).first()
    factor = discounts({r: pairs[r - 1] or 0 for r in range(1, SMALL + 2)})

    # the hash with its top bit set stands for a token beyond the head; the table has the hash itself
    joined = table.select(F.col("word").bitwiseOR(F.lit(-1 << 63)).alias("b"), F.col("n").alias("_count"))
    rare = of_kind(RARE).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("r1").alias("r1")).join(joined, "b", "left")
    times = F.coalesce("_count", F.lit(0))
    nothing = F.lit(0).cast("long")
    of_rare = rare.select("a", (F.col("r1") * _log_unigram(times, model_)).alias("sum"),
                          (F.col("n") * F.log10(times + F.lit(1.0))).alias("base"),
                          F.when(times > 0, F.col("n")).otherwise(nothing).alias("known"))
    rare_mass = (of_kind(RARE_PAIR).select("a", "b").join(joined, "b")
                 .select("a", F.pow(F.lit(10.0), _log_unigram(F.col("_count"), model_)).alias("sum")))
    histories = of_kind(HISTORY).select("a", "n", "sum", *small).unionByName(rare_mass, allowMissingColumns=True)
    kept = sum((F.coalesce(F.sum(s), F.lit(0)) * (r * (1 - d)) for r, (s, d) in enumerate(zip(small, factor), 1)), F.lit(1.0))
    alpha = stored(histories.groupBy("a").agg((F.log10(kept / (F.sum("n") + 1)) - F.log10(1 - F.sum("sum"))).alias("alpha"))
                   .withColumnRenamed("a", "b"), "backoff")
    of_unseen = of_kind(UNSEEN).select("a", "b", "n").join(alpha, "b").select("a", (F.col("n") * F.col("alpha")).alias("sum"))

    discounted = sum((F.col(s) * math.log10(d) for s, d in zip(small, factor)), F.lit(0.0))
    sums = _document_sums(of_kind(SUMS).select("a", "n", "packed")).select("a", (F.col("sum") + discounted).alias("sum"))
    documents = of_kind(DOCUMENT).select("a", F.col("b").alias("doc_id"), F.col("r2").alias("train"), "base",
                                         F.col("n").alias("n_tokens"), F.col("r1").alias("known"))
    all_sums = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [sums, of_unseen, of_rare, documents])
    per_token = math.log10(model_.tokens + model_.types + 1)
    return (all_sums.groupBy("a").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("_train"), F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"), F.sum("base").alias("_base"), F.sum("sum").alias("score"))
        .select("doc_id", (F.col("_train") == 1).alias("trained"), "n_tokens", F.coalesce("n_known", nothing).alias("n_known"),
                F.lit(model_.tokens).cast("long").alias("train_tokens"),
                (F.col("_base") - F.col("n_tokens") * per_token).alias("base_score"), "score"))
