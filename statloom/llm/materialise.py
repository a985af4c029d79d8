"""Training-order materialisation: token sequences in shards of fixed stride, in a keyed pseudo-random order.

Documents are tokenized and, partition by partition, cut into sequences of equal length; only a partition's last
sequence is padded. A keyed Feistel network permutes the numbers of the sequences, walking along its cycles until it is
back inside their range, so every sequence has its own slot without any table or sort. A shard has the slots of one
range. Each is written by one task as a plain file of records of the same size, so slot ``s`` is found by arithmetic, and
reading goes on from any slot. A shard is written under another name and then renamed: a task that runs again replaces
it with the same bytes.

The number of sequences must be known before the first slot. Tokens are therefore counted in a first pass and made again
in the second, which costs time but no space; the second checks that it meets the counts of the first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.text import binary_parts, chunks, mix64, utf8
from statloom.sources.shared import shared_dir

INDEX = "slot long, shard int, position long, n_tokens int, ids_crc32 long, doc_ids array<long>"


@dataclass(frozen=True)
class OrderPlan:
    length: int = 2048            # tokens in a sequence
    end: int = 50256              # the id after each document, and the padding
    id_bytes: int = 2             # of an id, little-endian; 4 for vocabularies beyond 65,536
    largest: int = 32_768         # slots in a shard
    fewest_shards: int = 16       # while shards have more than 256 slots
    key: int = 7                  # of the permutation
    rounds: int = 6
    tokenizer: str | None = None

    @property
    def stride(self) -> int:
        return self.length * self.id_bytes

    def shard_slots(self, sequences: int) -> int:
        """A power of two that depends on the number of sequences alone."""
        return min(self.largest, max(256, 1 << max(0, (sequences // self.fewest_shards).bit_length() - 1)))


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The permutation of ``range(size)`` for ``key``, or its inverse, for some of the numbers."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    order = range(rounds)[::-1] if back else range(rounds)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for n in order:
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F) & (2 ** 64 - 1))
            if back:
                left, right = right ^ (mix64(left ^ salt) & mask), left
            else:
                left, right = right, left ^ (mix64(right ^ salt) & mask)
        return (left << shift) | right

    out = step(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def _streams(batches: Iterator[pa.RecordBatch], plan: OrderPlan) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Per chunk the ids of its documents, each with its end, where documents begin, and their doc_ids."""
    from statloom.llm.tokens import encoder
    encode = encoder(plan.tokenizer).encode
    for chunk in chunks(batches, "_bytes", keep=encoder):
        ids, before = encode(*binary_parts(chunk.column("_bytes")))
        begin = before + np.arange(len(before))
        stream = np.full(begin[-1], plan.end, np.uint32)
        inner = np.ones(len(stream), bool)
        inner[begin[1:] - 1] = False
        stream[inner] = ids
        yield stream, begin, chunk.column("doc_id")


def _token_counts(docs: DataFrame, plan: OrderPlan) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from statloom.llm.tokens import encoder
        encode, total = encoder(plan.tokenizer).encode, 0
        for chunk in chunks(batches, "_bytes", keep=encoder):
            _, before = encode(*binary_parts(chunk.column("_bytes")), ids=False)
            total += int(before[-1]) + chunk.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total])], ["part", "n"])

    return {r["part"]: r["n"] for r in docs.mapInArrow(run, "part long, n long").collect()}  # a row per partition


def _sequences(docs: DataFrame, plan: OrderPlan, counts: dict[int, int]) -> DataFrame:
    """Every sequence with its slot: ``slot, shard, n_tokens, doc_ids, packed`` (compressed ids)."""
    parts = sorted(counts)
    sizes = np.array([-(-counts[p] // plan.length) for p in parts], np.int64)
    first = dict(zip(parts, (np.cumsum(sizes) - sizes).tolist()))
    total = int(sizes.sum())
    per_shard = plan.shard_slots(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, zstd = TaskContext.get().partitionId(), pa.Codec("zstd", 1)
        number, met = first.get(part, 0), 0
        left, left_begin, left_docs = np.zeros(0, np.uint32), np.zeros(0, np.int64), pa.array([], pa.int64())

        def cut(stream: np.ndarray, begin: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            rows = len(lengths)
            slots = feistel(np.arange(number, number + rows), total, plan.key, plan.rounds)
            number += rows
            packed = [zstd.compress(r.tobytes(), asbytes=True) for r in stream.reshape(rows, -1).astype(f"<u{plan.id_bytes}")]
            edges = np.arange(rows) * plan.length
            low = np.searchsorted(begin, edges, side="right") - 1     # the document that an edge falls into
            high = np.searchsorted(begin, edges + lengths, side="left")
            held = doc_ids.take(pa.array(np.concatenate([np.arange(a, b) for a, b in zip(low, high)])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)), held)
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), pa.array(lengths.astype(np.int32)), lists,
                 pa.array(packed, pa.binary())], ["slot", "shard", "n_tokens", "doc_ids", "packed"])

        for stream, begin, doc_ids in _streams(batches, plan):
            met += len(stream)
            begin = np.concatenate([left_begin, begin[:-1] + len(left)])
            stream = np.concatenate([left, stream])
            doc_ids = pa.concat_arrays([left_docs, doc_ids])
            rows = len(stream) // plan.length
            edge = rows * plan.length
            if rows:
                yield cut(stream[:edge], begin, doc_ids, np.full(rows, plan.length))
            kept = int(np.searchsorted(begin, edge, side="right")) - 1 if edge < len(stream) else len(begin)
            left, left_begin, left_docs = stream[edge:], begin[kept:] - edge, doc_ids[kept:]
        if len(left):
            padded = np.full(plan.length, plan.end, np.uint32)
            padded[:len(left)] = left
            yield cut(padded, left_begin, left_docs, np.array([len(left)]))
        if met != counts.get(part, 0):
            raise RuntimeError("the input was partitioned differently than when its tokens were counted; run again")

    return docs.mapInArrow(run, "slot long, shard int, n_tokens int, doc_ids array<long>, packed binary")


def shard_file(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:08d}.bin"


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def materialise(docs: DataFrame, folder: str | None = None, plan: OrderPlan = OrderPlan()) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) to ``folder`` and return their index, a row of ``INDEX`` per slot.

    ``folder`` is a new folder that all executors reach, by default in the cluster's shared folder. ``position`` is the
    byte where a slot begins in its shard, ``n_tokens`` counts its ids without padding, ``ids_crc32`` covers the whole
    record, ``doc_ids`` are the documents in it. A NULL or empty text is its end id; repeated rows and NULL doc_ids are
    documents of their own; without rows there are no shards and no slots. Other columns are ignored. The index is also
    stored in the folder, with ``plan.json`` beside it.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "training-order")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("_bytes"))
    counts = _token_counts(given, plan)
    total = sum(-(-n // plan.length) for n in counts.values())
    per_shard = plan.shard_slots(total)
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/plan.json") as out:
        out.write(json.dumps({"sequences": total, "shard_slots": per_shard, "length": plan.length, "id_bytes": plan.id_bytes,
                              "key": plan.key, "rounds": plan.rounds}).encode())

    def write(table: pa.Table) -> pa.Table:
        shard, zstd = table.column("shard")[0].as_py(), pa.Codec("zstd")
        table = table.sort_by("slot")
        slots = table.column("slot").to_numpy()
        first = shard * per_shard
        if not np.array_equal(slots, np.arange(first, min(first + per_shard, total))):
            raise RuntimeError(f"shard {shard} does not have each of its slots once")
        files, path = _open(folder)
        name = shard_file(path, shard)
        draft = f"{name}.{TaskContext.get().taskAttemptId()}"
        sums = []
        with files.open_output_stream(draft) as out:
            for packed in table.column("packed"):
                raw = zstd.decompress(packed.as_py(), plan.stride, asbytes=True)
                sums.append(zlib.crc32(raw))
                out.write(raw)
        files.move(draft, name)
        return pa.Table.from_arrays(
            [table.column("slot"), table.column("shard"), pa.array((slots - first) * plan.stride), table.column("n_tokens"),
             pa.array(sums, pa.int64()), table.column("doc_ids")], [c.split()[0] for c in INDEX.split(", ")])

    index = _sequences(given, plan, counts).groupBy("shard").applyInArrow(write, INDEX)
    at = f"{folder.rstrip('/')}/index"
    index.write.mode("overwrite").parquet(at)
    return spark.read.schema(index.schema).parquet(at)


def read_slots(folder: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """The id sequences of the slots from ``start`` on, one after the other."""
    files, path = _open(folder)
    with files.open_input_stream(f"{path}/plan.json") as plan_file:
        plan = json.loads(plan_file.read())
    stride, per_shard = plan["length"] * plan["id_bytes"], plan["shard_slots"]
    stop = plan["sequences"] if count is None else min(plan["sequences"], start + count)
    while start < stop:
        shard = start // per_shard
        with files.open_input_file(shard_file(path, shard)) as records:
            records.seek((start - shard * per_shard) * stride)
            for _ in range(start, min(stop, (shard + 1) * per_shard)):
                yield np.frombuffer(records.read(stride), f"<u{plan['id_bytes']}")
                start += 1
