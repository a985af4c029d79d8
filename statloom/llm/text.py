"""Words and hashes of whole texts, vectorised over the bytes of an Arrow batch.

Texts travel to Python as UTF-8 bytes (``utf8``), so text that is not valid UTF-8 does no harm. A batch is handled in
chunks of a few megabytes; only a single longer text makes a longer chunk. Every word gets a 64-bit hash, a
polynomial over a table of random values per byte: the hash of any slice follows from running sums, whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 3 << 19
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_IS_BLANK_WORD = np.ones(256, bool)
_IS_BLANK_WORD[list(BLANKS)] = False
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def utf8(column: str | Column, null_as: str = "") -> Column:
    """A text column as UTF-8 bytes for Python; NULL is read as ``null_as``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(null_as)).cast("binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _sized(n: int) -> int:
    """Powers are kept for the usual chunk; a longer text gets its own, rounded up."""
    return CHUNK_BYTES + 1 if n <= CHUNK_BYTES + 1 else 1 << n.bit_length()


class SliceHash:
    """Hashes of any slices of one buffer."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _powers(_sized(len(data) + 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.powers[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of a chunk of texts: ``[start, end)`` in ``data``; text ``i`` has words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash per word, some texts at a time where the chunk is large."""
        if len(self.data) <= CHUNK_BYTES:
            return SliceHash(self.data)(self.start, self.end)
        out, low = np.empty(len(self.start), np.uint64), 0
        while low < len(self.counts):
            high = int(np.searchsorted(self.offsets, self.offsets[low] + CHUNK_BYTES, side="right")) - 1
            high = min(max(high, low + 1), len(self.counts))
            some, at = slice(self.first[low], self.first[high]), self.offsets[low]
            out[some] = SliceHash(self.data[at:self.offsets[high]])(self.start[some] - at, self.end[some] - at)
            low = high
        return out


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = True, alphanumeric: bool = False) -> Words:
    """Words of each text: runs without ASCII white space or, if ``alphanumeric``, of ASCII letters, digits and
    bytes of other characters."""
    if lower:
        data = _LOWER[data]
    inside = (_IS_ALNUM if alphanumeric else _IS_BLANK_WORD)[data]
    n, edges = len(data), offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = inside.copy(), inside.copy()
    if n:
        before = inside[:-1].copy()
        before[edges - 1] = False
        opens[1:] &= ~before
        after = inside[1:].copy()
        after[edges - 1] = False
        closes[:-1] &= ~after
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


@lru_cache(maxsize=1)
def _return_freed_memory() -> Callable[[int], int]:
    """Once in a worker: freed arrays of some megabytes go back to the system, so idle workers hold little beside a heap.

    Returns what gives back the free parts of that heap, too."""
    library = ctypes.CDLL(None)
    mallopt = getattr(library, "mallopt", None)
    if mallopt:
        for option, size in ((-3, 4 << 20), (-1, 8 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD of the C library
            mallopt(option, size)
    return getattr(library, "malloc_trim", lambda pad: 0)


#: Caches (``lru_cache``) that last from task to task of one kind, as an encoder does. Spark gives a worker tasks of any kind.
LASTING: list[Callable] = []


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES,
           keep: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``limit`` bytes of ``text``, or a single row.

    What tasks of other kinds left in the worker is dropped first, all of ``LASTING`` but ``keep``. After the last slice,
    what the worker keeps for the hashes of slices is dropped, too; the next task makes it again.
    """
    trim = _return_freed_memory()
    for cache in LASTING:
        if cache is not keep:
            cache.cache_clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = binary_parts(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim(0)


def words_of(chunk: pa.RecordBatch, text: str, **options) -> Words:
    return split(*binary_parts(chunk.column(chunk.schema.get_field_index(text))), **options)


def map_texts(docs: DataFrame, added: dict[str, str], compute: Callable[[pa.Array], list]) -> DataFrame:
    """The columns of ``docs`` and those of ``added`` (name: type), which ``compute`` gives for a chunk of texts as bytes.

    Columns of ``docs`` with the names of new ones are replaced; the others pass through as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row")
    given = docs.select(row, utf8("text").alias("bytes"))
    schema = T.StructType([given.schema["row"]])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "bytes"):
            results = [pa.array(r) for r in compute(chunk.column("bytes"))]
            yield pa.RecordBatch.from_arrays([chunk.column("row"), *results], ["row", *added])

    return given.mapInArrow(run, schema).select("row.*", *added)
