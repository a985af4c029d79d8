"""Best-fit packing of token pieces into fixed-length sequences by sums of squares.

Only a document longer than a sequence is cut, from its end, so that just its first piece may be shorter than a
sequence. A full piece is a sequence by itself. The others are dealt into lots of a few thousand, without regard to
what they hold, and each lot is packed by one task, longest first: a piece goes into the open sequence after which
the sum over gaps of the squared number of open sequences with that gap is smallest; only if none has room, a new one
is opened. The lots' size doesn't depend on the data, so tasks stay small, and each lot leaves about one sequence
partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.text import binary_parts, chunks, utf8
from statloom.llm.work import stored

CAPACITY = 2048
LOT = 8192  # pieces packed together
END = 0     # the id after each document

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _number long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and a unique ``_number``.

    With ``with_ids`` also ``ids``, the piece's ids as little-endian unsigned 32-bit values.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from statloom.llm.tokens import encoder
        encode_texts = encoder(tokenizer).encode
        number = TaskContext.get().partitionId() << 40
        for chunk in chunks(batches, "text", keep=encoder):
            ids, before = encode_texts(*binary_parts(chunk.column("text")))
            raw, doc_ids = ids.astype("<u4", copy=False).tobytes(), chunk.column("doc_id")
            lengths = np.diff(before) + 1
            counts = (lengths + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            shift = capacity * counts[doc] - lengths[doc]  # tokens that the first piece is short
            start = np.maximum(piece * capacity - shift, 0)
            stop = (piece + 1) * capacity - shift
            last = stop == lengths[doc]
            parts, end = [], np.array([END], "<u4").tobytes()
            for a, b, tail in zip(4 * (before[doc] + start), 4 * (before[doc] + stop), last):
                parts.append(raw[a:b - 4] + end if tail else raw[a:b])
            columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(stop - start, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                       pa.array(number + np.arange(len(doc)), pa.int64())]
            number += len(doc)
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECE + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(encode, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there, for pieces in the order in which they are placed.

    Among equally good places the one with the smallest gap is taken.
    """
    count = np.zeros(capacity + 1, np.int64)           # open sequences by gap; a full one counts for nothing
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    chosen, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for n, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            here = count[size:capacity]
            change = np.where(here > 0, 2 * (count[:capacity - size] - here) + 2, never)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            best = int(change.argmin())
            if change[best] < never:
                gap = size + best
        if gap == capacity:
            sequence, opened = opened, opened + 1
        else:
            sequence = by_gap[gap].pop()
            count[gap] -= 1
        chosen[n], offset[n] = sequence, capacity - gap
        if gap > size:
            by_gap[gap - size].append(sequence)
            count[gap - size] += 1
    return chosen, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, lot: int = LOT,
         with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id`` and ``offset``, gapless from 0.

    A NULL or empty text is one piece with the end id alone. Repeated rows and NULL doc_ids are documents of their
    own. Without rows the result is empty; columns other than doc_id and text are ignored.
    """
    def place(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("_number").to_numpy(), -length))
        sequence, offset = sum_of_squares(length[order], capacity)
        table = table.take(pa.array(order))
        at = (table.column("_lot").to_numpy() << 24) + sequence
        return (table.drop_columns(["_lot", "_number"]).append_column("sequence_id", pa.array(at, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    cut = stored(pieces(docs, capacity, tokenizer, with_ids), "pieces")
    short = cut.filter(F.col("length") < capacity)
    lots = max(1, round(short.count() / lot))
    schema = PIECE.replace("_number", "sequence_id") + ", offset long"
    if with_ids:
        schema = PIECE.replace(", _number long", ", ids binary, sequence_id long, offset long")
    packed = (short.withColumn("_lot", F.pmod(F.xxhash64("_number"), F.lit(lots)))
              .groupBy("_lot").applyInArrow(place, schema))
    full = (cut.filter(F.col("length") == capacity)
            .withColumn("sequence_id", -1 - F.col("_number")).withColumn("offset", F.lit(0).cast("long")))
    return packed.unionByName(full.drop("_number"))


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids`` (as in ``pieces``) and their ``doc_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (pack(docs, capacity, tokenizer, with_ids=True).groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), parts.alias("_parts"))
            .select("sequence_id", "length",
                    F.aggregate("_parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"),
                    F.col("_parts.doc_id").alias("doc_ids")))
