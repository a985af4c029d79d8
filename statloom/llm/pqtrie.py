"""Vector code compression: product codes whose codebooks are fitted over lexicographic tries.

A vector of whole numbers is cut into equal parts, and a part's code is the nearest entry of its codebook. Parts with
equal leading dimensions have equal leading terms in their distances to all entries. The distinct parts of a chunk of
vectors are therefore sorted, which makes them the leaves of a trie with a level per dimension, and the trie is walked
depth first: a node adds its dimension's squared differences to the vector of distances, one per entry, that its parent
has, for all leaves below it at once. A subtree that is small enough is finished level by level in arrays; the others are
opened child by child, so that few distance vectors are held at a time. A leaf takes the first least distance and counts
with the number of its repetitions.

Every round is one pass over the vectors without a shuffle of them: a task sends the sums and counts of its parts by
entry, whose number is that of the codebooks and not of the vectors. All numbers are integers and exact, so the order
of tasks changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import exact
from statloom.llm.work import stored

SUBTREE = 1 << 12   # leaves finished together
CHUNK = 1 << 14     # vectors whose parts share tries


@dataclass(frozen=True)
class CodePlan:
    scale: int = 256     # of the components before they are rounded down
    parts: int = 16
    entries: int = 64    # of a codebook, at most 256
    rounds: int = 2


class Trie:
    """The distinct rows of a table of parts, sorted; ``leaf_of`` tells each row's leaf and ``weight`` counts its rows."""

    def __init__(self, parts: np.ndarray):
        rows, dims = parts.shape
        order = (np.lexsort(parts.T[::-1]) if parts.dtype != object
                 else np.array(sorted(range(rows), key=lambda r: parts[r].tolist()), np.int64))
        ordered = parts[order]
        #: for every level, where a new prefix of that many dimensions begins
        self.new = np.ones((dims + 1, rows), bool)
        self.new[0, 1:] = False
        for d in range(dims):
            self.new[d + 1, 1:] = self.new[d, 1:] | (ordered[1:, d] != ordered[:-1, d])
        first = np.flatnonzero(self.new[dims])
        self.leaves = ordered[first]
        self.new = self.new[:, first]
        self.weight = np.diff(np.append(first, rows))
        self.leaf_of = np.empty(rows, np.int64)
        self.leaf_of[order] = np.repeat(np.arange(len(first)), self.weight)

    def nearest(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each leaf's nearest entry and squared distance; and how many distance terms were computed."""
        count, dims = self.leaves.shape
        best, error = np.zeros(count, np.int64), np.zeros(count, self.leaves.dtype)
        computed, start = 0, np.zeros((1, len(codebook)), self.leaves.dtype)
        stack = [(0, count, 0, start)] if count else []     # leaves from, to, level, distances of the prefix
        while stack:
            low, high, level, held = stack.pop()
            if level < dims and high - low > SUBTREE:
                begin = low + np.flatnonzero(self.new[level + 1, low:high])
                terms = (self.leaves[begin, level][:, None] - codebook[None, :, level]) ** 2
                computed += terms.size
                ends = np.append(begin[1:], high)
                stack += [(b, e, level + 1, held + t) for b, e, t in zip(begin.tolist(), ends.tolist(), terms)][::-1]
                continue
            above = np.zeros(high - low, np.int64)          # of each leaf, its place in ``held``
            for d in range(level, dims):
                new = self.new[d + 1, low:high].copy()
                new[0] = True
                begin = np.flatnonzero(new)
                terms = (self.leaves[low + begin, d][:, None] - codebook[None, :, d]) ** 2
                computed += terms.size
                held, above = held[above[begin]] + terms, np.cumsum(new) - 1
            held = held[above]
            best[low:high] = held.argmin(1)
            error[low:high] = held[np.arange(high - low), best[low:high]]
        return best, error, computed


def _tries(table: pa.Table, dim: int, books: list[np.ndarray], plan: CodePlan) -> Iterator[tuple[Trie, np.ndarray]]:
    """The trie and the codebook of each part, in one type of numbers."""
    vectors, width = exact.floors(table.column("_vector"), dim, plan.scale), dim // plan.parts
    for p, book in enumerate(books):
        part = vectors[:, p * width:(p + 1) * width]
        wide = object in (part.dtype, book.dtype)
        yield Trie(part.astype(object) if wide else part), book.astype(object) if wide else book


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _by_length(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    lengths = table.column("_dim").to_numpy()
    for dim in np.unique(lengths).tolist():
        yield dim, table.filter(pa.array(lengths == dim))


def _round(kept: DataFrame, books: dict[int, list[np.ndarray]], plan: CodePlan) -> dict[int, list[np.ndarray]]:
    """The codebooks after one round of assignment and means."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int, int], int] = {}   # length, part, entry, dimension (-1: the count)
        for table in _chunked(batches):
            for dim, some in _by_length(table):
                if dim not in books:
                    continue
                for p, (trie, book) in enumerate(_tries(some, dim, books[dim], plan)):
                    best, _, _ = trie.nearest(book)
                    for entry in np.unique(best).tolist():
                        mine = best == entry
                        weight = trie.weight[mine]
                        totals = (trie.leaves[mine] * weight[:, None]).sum(0).tolist()
                        for d, total in enumerate([int(weight.sum()), *totals], -1):
                            at = (dim, p, entry, d)
                            sums[at] = sums.get(at, 0) + total
        rows = [(*at, exact.limbs(total)) for at, total in sums.items()]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "part", "entry", "d", "limbs"])

    partial = kept.select("_dim", "_vector").mapInArrow(run, "dim int, part int, entry int, d int, limbs array<long>")
    totals = exact.totals(partial, ["dim", "part", "entry", "d"])
    out = {dim: [book.astype(object) for book in own] for dim, own in books.items()}
    for (dim, p, entry, d), total in totals.items():
        if d >= 0:
            out[dim][p][entry, d] = total // totals[dim, p, entry, -1]
    return out


def _narrow(book: np.ndarray) -> np.ndarray:
    """64-bit entries where all are small."""
    small = all(abs(v) < exact.SMALL for v in book.ravel().tolist())
    return book.astype(np.int64) if small else book


def fit(kept: DataFrame, plan: CodePlan) -> dict[int, list[np.ndarray]]:
    """Codebooks by vector length and part, from ``vec_id, _dim, _vector``."""
    books: dict[int, list[np.ndarray]] = {}
    for dim in sorted(r._dim for r in kept.filter("vec_id is not null").select("_dim").distinct().collect()):
        seeds = (kept.filter((F.col("_dim") == dim) & F.col("vec_id").isNotNull()).orderBy("vec_id", "_vector")
                 .limit(plan.entries).select("_vector").collect())
        start = exact.floors(pa.array([r._vector for r in seeds], pa.list_(pa.float64())), dim, plan.scale).astype(object)
        width = dim // plan.parts
        books[dim] = [start[:, p * width:(p + 1) * width].copy() for p in range(plan.parts)]
    for _ in range(plan.rounds):
        books = _round(kept, {dim: [_narrow(b) for b in own] for dim, own in books.items()}, plan)
    return books


def digest(books: dict[int, list[np.ndarray]]) -> str:
    """sha256 over all components in decimal, by length, part, entry and place."""
    values = (str(int(v)) for dim in sorted(books) for book in books[dim] for v in book.ravel().tolist())
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def compress(vectors: DataFrame, plan: CodePlan = CodePlan()) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that can be coded.

    ``vectors`` has ``vec_id, embedding, label``; others are ignored. A code has two hex digits per part. Left out are
    NULL vectors, vectors with NULL or non-finite components and those whose length isn't a positive multiple of the
    number of parts. Vectors of each length have codebooks of their own, from those rows of the smallest vec_ids that
    there are; ties among repeated vec_ids go by the vector, rows with a NULL vec_id are coded but start no codebook, and
    without any vec_id of their length they are left out. Errors that 64 bits can't hold are NULL. No rows give no rows.
    """
    dim = F.size("embedding")
    kept = (vectors.filter(exact.usable(F.col("embedding")) & (dim > 0) & (dim % plan.parts == 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), dim.alias("_dim"),
                    F.col("embedding").cast("array<double>").alias("_vector")))
    books = fit(kept, plan)
    narrow = {dim: [_narrow(b) for b in own] for dim, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunked(batches):
            for dim, some in _by_length(table):
                if dim not in narrow:
                    continue
                codes, errors = np.empty((some.num_rows, plan.parts), np.uint8), np.zeros(some.num_rows, np.int64)
                for p, (trie, book) in enumerate(_tries(some, dim, narrow[dim], plan)):
                    best, error, _ = trie.nearest(book)
                    codes[:, p] = best[trie.leaf_of]
                    errors = errors + error[trie.leaf_of]
                kept_columns = some.select(["vec_id", "label"]).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*[c.combine_chunks() for c in kept_columns.columns], pa.array([c.tobytes().hex() for c in codes]),
                     exact.longs(errors.tolist())], ["vec_id", "label", "code", "error"])

    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    coded = stored(kept.mapInArrow(run, schema), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
            .withColumn("codebooks_sha256", F.lit(digest(books))))
