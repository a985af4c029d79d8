"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Two sets of sizes n and m are linked if and only if they have c(n, m) = ceil(percent * (n + m) / (100 + percent)) shingles
in common. A small set therefore lists its subsets of each such size c, of which linked sets share at least one; it leaves
out at most a few shingles, so the subsets are few. A large set looks into the inverted lists of its shingles: with
all sets in one order of shingles, rarest first, linked sets share one of the first n - ceil(percent * n / 100) + 1, and
only those lists are kept and scanned, each once per band of sizes within which links are possible. The boundary
between small and large is the one with the least cost, subsets made against list entries read, both counted on the data;
sets just below it, which large ones can be linked to, are in the lists too.

A scan of short lists counts, for each two sets, the shingles they have in common there. All others that they can have in
common stand in long lists or after the first shingles, which bounds their similarity; most pairs end there. Long lists
and subset groups go to ``groups``, which never makes all pairs of a list, and so do the remaining pairs, to be confirmed
on whole sets. Rarity comes from a sketch of counts whose size is fixed: any order gives the same links, a better one
shorter lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.groups import linked
from statloom.llm.minhash import by_component, optional, sets_of_classes, texts_as_sets
from statloom.llm.text import mix64, utf8
from statloom.llm.work import stored

SKETCH_BITS = 23     # cells of the sketch of counts: 2^23 bytes when it is sent out
SLICES = 64          # in which the sketch is added up
COUNTED = 1 << 21    # shingles added to a task's counts at once
SHORT = 16           # entries of a list that is scanned entry by entry


@dataclass(frozen=True)
class JoinPlan:
    """Shingles of ``shingle`` words; links need ``percent`` of the union in common; no set above ``largest_small``
    shingles, or with more than ``most_subsets`` subsets, can be small."""

    shingle: int = 3
    percent: int = 90
    largest_small: int = 30
    most_subsets: int = 512


def needed(n: int, m: int, percent: int) -> int:
    """How many shingles linked sets of these sizes have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """The sizes of subsets that a small set of ``n`` shingles lists: one for every size of a possible partner."""
    return sorted({needed(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)})


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def subset_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A key per subset; the same subset has the same key in every set."""
    n, hashes = len(shingles), mix64(shingles.view(np.uint64))
    total, keys = hashes.sum(dtype=np.uint64), []
    for c in subset_sizes(n, percent):
        left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
        keys.append(mix64(total - hashes[left_out].sum(1, dtype=np.uint64) + np.uint64(2 * c)))
    return np.concatenate(keys).view(np.int64)


def bands_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The band of each size; a size and any partner of a possible link are in the same or adjoining bands."""
    edges, top = [1], int(sizes.max(initial=1))
    while edges[-1] <= top:
        edges.append(100 * edges[-1] // percent + 1)
    return np.searchsorted(np.array(edges), sizes, side="right")


def count_sketch(docs: DataFrame, plan: JoinPlan) -> np.ndarray:
    """Per cell of hashed shingles about eight times the logarithm of how many sets of ``docs`` hold one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        cells: list[np.ndarray] = []

        def count() -> None:
            counts[:] += np.bincount(np.concatenate(cells), minlength=len(counts)).astype(np.int32)
            cells.clear()

        for _, values, _, _, _ in texts_as_sets(batches, plan, prints=False):
            cells.append((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            if sum(map(len, cells)) >= COUNTED:
                count()
        if cells:
            count()
        if counts.any():
            packed = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    size = (1 << SKETCH_BITS) // SLICES

    def add(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(size, np.int64), None
        for batch in table:
            at = batch.column("slice")[0].as_py()
            for packed in batch.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(packed, 4 * size, "zstd"), np.int32)
        levels = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["slice", "levels"])

    partial = docs.select(utf8("text").alias("_bytes")).mapInArrow(run, "slice int, counts binary")
    out = np.zeros((SLICES, size), np.uint8)
    for row in partial.groupBy("slice").applyInArrow(add, "slice int, levels binary").collect():
        out[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def _sketched(docs: DataFrame, plan: JoinPlan, sketch: Broadcast) -> DataFrame:
    """``doc_id, n_shingles, print, band, rarest, whole`` of every row: the shingles whose lists a set is in, and for sets
    that may be small all of them. The last four are NULL without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sketch.value
        for chunk, values, first, filled, prints in texts_as_sets(batches, plan):
            sizes = np.diff(first)
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(text * 256 + level[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
            length = np.where(sizes > 0, sizes - -(-plan.percent * sizes // 100) + 1, 0)
            chosen = np.arange(len(values)) - first[text] < length[text]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)),
                                             pa.array(values[order][chosen].view(np.int64)))
            small = (sizes > 0) & (sizes <= plan.largest_small)
            kept = np.where(small, sizes, 0)
            whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)),
                                             pa.array(values[small[text]].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(sizes.astype(np.int64)), optional(prints, filled, chunk.num_rows, pa.binary()),
                 pa.array(bands_of(sizes, plan.percent).astype(np.int32)), lists, whole],
                ["doc_id", "n_shingles", "print", "band", "rarest", "whole"])

    return (docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_bytes"))
            .mapInArrow(run, "doc_id long, n_shingles long, print binary, band int, rarest array<long>, whole array<long>"))


def boundary(lists: DataFrame, plan: JoinPlan) -> int:
    """The largest size of a small set: the least cost of subsets up to it and of list entries read beyond it.

    ``lists`` has ``n`` and ``length``, an entry of a list of two sets or more each; without any the answer is 0.
    """
    most = max((n for n in range(1, plan.largest_small + 1) if subset_count(n, plan.percent) <= plan.most_subsets), default=0)
    rows = lists.filter(F.col("n") <= most).groupBy("n").agg(F.sum("length").alias("read"), F.countDistinct("id").alias("sets")).collect()
    read = {r["n"]: r["read"] for r in rows}
    made = {r["n"]: r["sets"] * subset_count(r["n"], plan.percent) for r in rows}
    cost, best = {}, 0
    for x in range(most + 1):
        in_lists = -(-plan.percent * (x + 1) // 100)
        cost[x] = sum(v for n, v in made.items() if n <= x) + sum(v for n, v in read.items() if n >= in_lists)
        best = x if cost[x] < cost[best] else best
    return best


def _small_members(classes: DataFrame, x: int, plan: JoinPlan) -> DataFrame:
    """``key, id, n``: the subsets of small sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in zip(batch.column("id").to_pylist(), batch.column("whole").to_pylist()):
                keys = subset_keys(np.array(whole, np.int64), plan.percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(len(keys), i)), pa.array(np.full(len(keys), len(whole)))], ["key", "id", "n"])

    return classes.filter(F.col("n") <= x).select("id", "whole").mapInArrow(run, "key long, id long, n long")


def scanned_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b, n, m``: sets of which short lists leave open whether they are linked, and their sizes, the larger one first.

    ``lists`` has ``shingle, length, id, n``; a short list has at most ``SHORT`` entries, so an entry meets no more others.
    """
    slack = lists.groupBy("id").agg(F.count(F.when(F.col("length") > SHORT, 1)).alias("slack"))
    entries = (lists.filter(F.col("length") <= SHORT).join(slack, "id").groupBy("shingle")
               .agg(F.sort_array(F.collect_list(F.struct("id", "n", "slack"))).alias("e")))
    larger = lambda x, y: F.struct(x["n"], x["id"]) > F.struct(y["n"], y["id"])
    possible = lambda x, y: larger(x, y) & (100 * y["n"] >= percent * x["n"])
    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: possible(x, y)), lambda y: F.struct(
        x["id"].alias("a"), y["id"].alias("b"), x["n"].alias("n"), y["n"].alias("m"), F.least(x["slack"], y["slack"]).alias("slack")))))
    met = entries.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b", "n", "m", "slack").agg(F.count(F.lit(1)).alias("common"))
    least = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent) - 1e-9)
    after = F.ceil(F.col("n") * percent / 100 - 1e-9) - 1
    return met.filter(F.col("common") + F.col("slack") + after >= least).select("a", "b", "n", "m")


def near_components(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """``doc_id, n_shingles, print, root, component_id`` for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach. Rows with equal sets are linked, whatever their doc_id, and
    rows sharing a doc_id but not their text are different documents. Rows without words or with a NULL text are linked
    with nothing: ``print`` and ``root`` are NULL and they are their own component. A NULL doc_id counts only where a
    component has no other. Other columns are ignored; without rows the result is empty.
    """
    docs = docs.select("doc_id", "text")
    sketch = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, plan))
    sketched = stored(_sketched(docs, plan, sketch), "sketches")
    sketch.unpersist()
    classes = stored(sketched.filter("print is not null").groupBy("print").agg(
        F.first("n_shingles").alias("n"), F.first("band").alias("band"), F.first("rarest").alias("rarest"),
        F.first("whole").alias("whole"), F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "classes")
    entries = classes.select("id", "n", "band", F.explode("rarest").alias("shingle"))
    several = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    lists = stored(entries.join(several, "shingle"), "lists")

    x = boundary(lists, plan)
    in_lists = lists.filter(F.col("n") >= -(-plan.percent * (x + 1) // 100))
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), "n"), F.struct(F.col("b").alias("id"), F.col("m").alias("n"))))
    paired = (scanned_pairs(in_lists, plan.percent)   # a set and all smaller ones make a group, whose head others have too
              .select(F.xxhash64("a").alias("key"), both.alias("_e")).select("key", "_e.*").distinct())
    band = F.explode(F.array("band", F.col("band") + 1))
    large = (in_lists.filter(F.col("length") > SHORT).select("id", "n", "shingle", band.alias("band"))
             .select(F.xxhash64("shingle", "band").alias("key"), "id", "n").unionAll(paired))
    members = _small_members(classes, x, plan).unionAll(large) if x else large
    roots = linked(members, lambda wanted: sets_of_classes(docs, classes, wanted, plan), plan.percent)
    return by_component(sketched, classes, roots)


def join(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; cases as in ``near_components``."""
    return near_components(docs, plan).select("doc_id", "n_shingles", "component_id")
