"""Near duplicates by circulant MinHash, banding and exact verification.

A document is the set of its word shingles. Two permutations of the 32-bit numbers make its whole signature: the first
scatters the set, and coordinate k is the least value that the second, circularly shifted by k, gives to it. Documents
with equal sets form a class and go on as one. Classes that agree in a band of coordinates are candidates: at a
similarity of 0.85, 32 bands of 5 miss a pair with a probability of 7e-9.

No group of a band is expanded into pairs: ``groups`` compares its members to a head and goes on with those too far
from it by their differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.groups import linked
from statloom.llm.text import Words, chunks, mix64, utf8, words_of
from statloom.llm.work import stored


@dataclass(frozen=True)
class NearPlan:
    """Shingles of ``shingle`` words; links need ``percent`` of the union in common."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted hashes, and where each text's begin (one more at the end).

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    hashes, counts = words.hashes(), words.counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per_text)
    begin = np.repeat(words.first[:-1], per_text) + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    length = np.minimum(counts, size)[text]
    value = np.zeros(len(text), np.uint64)
    for n in range(size):
        inside = n < length
        value[inside] = mix64(value[inside] * np.uint64(0x9DDFEA08EB382D69) + hashes[begin[inside] + n] + np.uint64(n + 1))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(17))
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    return x ^ (x >> np.uint32(15))


def _permute(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(values: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row per set."""
    scattered = _scatter((values >> np.uint64(32)).astype(np.uint32))
    out = np.empty((len(begin), coordinates), np.uint32)
    shifted, spare = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(coordinates):
        np.add(scattered, np.uint32(k), out=shifted)
        out[:, k] = np.minimum.reduceat(_permute(shifted, spare), begin)
    return out


def band_keys(signature: np.ndarray, plan: NearPlan) -> np.ndarray:
    """A 64-bit key per set and band; keys of different bands differ."""
    parts = signature.reshape(len(signature), plan.bands, plan.rows).astype(np.uint64)
    keys = np.tile(np.arange(1, plan.bands + 1, dtype=np.uint64), (len(signature), 1))
    for n in range(plan.rows):
        keys = mix64(keys * np.uint64(0x9DDFEA08EB382D69) + parts[:, :, n])
    return keys.view(np.int64)


def _prints(values: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """128 bits for each non-empty set, from sums over its members."""
    halves = [np.add.reduceat(mix64(values ^ np.uint64(seed)), begin) for seed in (0x1234567, 0xFEDCBA9876543210)]
    return [row.tobytes() for row in np.stack(halves, 1)]


def texts_as_sets(batches: Iterator[pa.RecordBatch], plan, prints: bool = True) -> Iterator[tuple]:
    """Chunks with the shingles of their texts, which texts have any, and those texts' set prints."""
    for chunk in chunks(batches, "_bytes"):
        values, first = shingle_sets(words_of(chunk, "_bytes"), plan.shingle)
        filled = np.flatnonzero(np.diff(first))
        yield chunk, values, first, filled, _prints(values, first[filled]) if prints and len(filled) else []


def optional(values: list, at: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    out: list = [None] * rows
    for n, value in zip(at.tolist(), values):
        out[n] = value
    return pa.array(out, kind)


def _sketched(docs: DataFrame, plan: NearPlan) -> DataFrame:
    """``doc_id, n_shingles, print, bands`` of every row; the last two are NULL without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, values, first, filled, prints in texts_as_sets(batches, plan):
            rows, sizes = chunk.num_rows, np.diff(first)
            lengths = np.zeros(rows + 1, np.int32)
            keys = np.zeros(0, np.int64)
            if len(filled):
                keys = band_keys(signatures(values, first[filled], plan.bands * plan.rows), plan).ravel()
                lengths[filled + 1] = plan.bands
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(sizes.astype(np.int64)),
                 optional(prints, filled, rows, pa.binary()), bands], ["doc_id", "n_shingles", "print", "bands"])

    return (docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_bytes"))
            .mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>"))


def _sets(docs: DataFrame, plan) -> DataFrame:
    """``print, shingles`` of every row with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, first, filled, prints in texts_as_sets(batches, plan):
            held = pa.ListArray.from_arrays(pa.array(first[np.append(filled, len(first) - 1)].astype(np.int32)),
                                            pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), held], ["print", "shingles"])

    return docs.select(utf8("text").alias("_bytes")).mapInArrow(run, "print binary, shingles array<long>")


def sets_of_classes(docs: DataFrame, classes: DataFrame, wanted: DataFrame, plan) -> DataFrame:
    """``id, shingles`` of the wanted classes, each from the rows that have its smallest doc_id."""
    some = stored(classes.join(wanted, "id", "left_semi").select("id", "print", "least"), "wanted")
    texts = docs.join(some.select(F.col("least").alias("_least")).distinct(),
                      F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    return _sets(texts, plan).join(some.select("id", "print"), "print").drop("print").dropDuplicates(["id"])


def by_component(sketched: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, print, root, component_id`` of all rows, from the roots of linked classes."""
    known = (classes.select("id", "print", "least").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .withColumn("root", F.coalesce("root", "id")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = stored(known.join(least, "root").select("print", "root", "component_id"), "components")
    with_words = sketched.filter("print is not null").select("doc_id", "n_shingles", "print").join(of_class, "print")
    without = (sketched.filter("print is null").select("doc_id", "n_shingles", "print", F.lit(None).cast("long").alias("root"),
                                                       F.col("doc_id").alias("component_id")))
    return with_words.select(*without.columns).unionAll(without)


def near_components(docs: DataFrame, plan: NearPlan = NearPlan()) -> DataFrame:
    """``doc_id, n_shingles, print, root, component_id`` for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id among all rows that links reach. Rows with equal sets are linked, whatever
    their doc_id; rows sharing a doc_id but not their text are different documents. Rows without words or with a NULL
    text are linked with nothing: their ``print`` and ``root`` are NULL and they are their own component. A NULL
    doc_id counts only where a component has no other, and then its ``component_id`` is NULL. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sketched = stored(_sketched(docs, plan), "sketches")
    classes = stored(sketched.filter("print is not null").groupBy("print").agg(
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"))
        .withColumn("id", F.monotonically_increasing_id()), "classes")

    members = classes.select("id", "n", F.explode("bands").alias("key"))
    roots = linked(members, lambda wanted: sets_of_classes(docs, classes, wanted, plan), plan.percent)
    return by_component(sketched, classes, roots)


def near_duplicates(docs: DataFrame, plan: NearPlan = NearPlan()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row; kept is the row with its component's smallest doc_id.

    Cases as in ``near_components``; rows repeating the kept doc_id and text are all kept here.
    """
    return near_components(docs, plan).select("doc_id", "n_shingles", "component_id",
                                              F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, plan: NearPlan = NearPlan()) -> DataFrame:
    """``docs`` with exactly one row of each component; rows without words are all kept."""
    chosen = (near_components(docs, plan).filter("print is not null").select("print", "root", "component_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, filled, prints in texts_as_sets(batches, plan):
            yield pa.RecordBatch.from_arrays(
                [*chunk.columns[:-1], optional(prints, filled, chunk.num_rows, pa.binary())],
                [*chunk.schema.names[:-1], "_print"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    given = docs.select(row, utf8("text").alias("_bytes"))
    printed = given.mapInArrow(run, given.drop("_bytes").schema.add("_print", "binary"))
    alone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    kept = (printed.join(chosen, F.col("_print") == F.col("print"), "left")
            .filter(F.col("_print").isNull() | F.col("_row.doc_id").cast("long").eqNullSafe(F.col("component_id")))
            .withColumn("_group", F.coalesce(F.col("root").cast("string"), alone)))
    return kept.dropDuplicates(["_group"]).select("_row.*")
