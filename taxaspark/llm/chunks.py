"""Corpus-wide counts of 64-bit keys, returned to the texts that hold them.

Texts are packed into chunks (about ``CHUNK_BYTES`` of text, compressed) in a table of
the shared folder.  Each chunk sends its distinct keys once, sorted and cut by the top
bits into buckets; a bucket adds up what all chunks sent and answers each chunk with
the totals of its keys, in its order.  So a key that a third of all texts hold costs one
entry per chunk, no group of rows ever forms, and sums are exact.  Keys travel as
binary columns of thousands, not as rows.

Buckets grow with the text (about ``BUCKET_KEYS`` keys each), so a task's memory does
not; both shuffles are plain hash shuffles of independent rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

CHUNK_BYTES = 12 << 20
BUCKET_KEYS = 1 << 20
_CODEC = "zstd"

CHUNK = "chunk bigint, n int, size bigint, ids array<bigint>, flags array<boolean>, body binary"


def pack(data: np.ndarray, offsets: np.ndarray, level: int = 4) -> bytes:
    raw = np.concatenate(([len(offsets)], offsets)).astype(np.int64).tobytes() + data.tobytes()
    return squeeze(raw, level)


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(unsqueeze(body), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    return raw[8 * (n + 1) :], raw[8 : 8 * (n + 1)].view(np.int64)


def make_chunks(docs: DataFrame, scratch: Scratch, flag: F.Column | None = None, most: int = CHUNK_BYTES, level: int = 4) -> DataFrame:
    """Pack (doc_id, text) into the table ``chunks``; ``flag`` is a boolean kept for each text, ``level`` how hard texts are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, flags = batch.column(0), batch.column(1)
            for a, b, data, offsets in T.runs(batch.column(2), most):
                row = [[(part << 32) + k], [b - a], [len(data)], [ids.slice(a, b - a).to_pylist()], [flags.slice(a, b - a).to_pylist()], [pack(data, offsets, level)]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["chunk", "n", "size", "ids", "flags", "body"])
                k += 1

    rows = docs.select("doc_id", (F.lit(False) if flag is None else flag).alias("flag"), "text")
    return scratch.write(rows.mapInArrow(run, CHUNK), "chunks", compression="none")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as 6-byte steps, or whole where a step is longer."""
    steps = np.diff(keys)
    if len(keys) and (not len(steps) or int(steps.max()) < 1 << 48):
        return b"\1" + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"\0" + keys.tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if raw[0] == 0:
        return raw[1:].copy().view(np.uint64)
    steps = np.zeros(((len(raw) - 9) // 6, 8), np.uint8)
    steps[:, :6] = raw[9:].reshape(-1, 6)
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = raw[1:9].copy().view(np.uint64)[0]
    out[1:] = steps.reshape(-1).view(np.uint64)
    return np.cumsum(out, dtype=np.uint64)


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.Codec(_CODEC, level).compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(memoryview(blob)[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)


def bucket_bits(chunks: DataFrame, keys_per_byte: float) -> int:
    """Bits of the bucket number for a table of chunks."""
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    return max(6, int(np.ceil(np.log2(max(1.0, total * keys_per_byte / BUCKET_KEYS)))))


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last + 1) of sorted keys."""
    top = (keys >> T.U64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield int(top[a]), a, b


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of rows with one value of ``column`` (the input is sorted by it)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column(column)[0].as_py() != v[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


REQUEST = "bucket int, chunk bigint, keys binary, counts binary"
ANSWER = "chunk bigint, bucket int, ids array<bigint>, flags array<boolean>, payload binary"


def add_up(blobs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the concatenated keys: each one's total, and whether it is the first of its kind."""
    keys, n = np.concatenate(blobs), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sums = np.add.reduceat(n[order].astype(np.int64), first)
    totals, owner = np.empty(len(keys), np.int64), np.zeros(len(keys), bool)
    totals[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    owner[order[first]] = True
    return totals, owner


def count_keys(chunks: DataFrame, keyer: Callable, bits: int, summary: Callable | None = None) -> DataFrame:
    """Answers to all chunks: uint32 pairs (total, 1 for the first chunk that holds the key), by bucket.

    ``keyer(data, offsets, flags)`` gives sorted distinct keys and their counts.
    ``summary(keys, totals)`` of each bucket's distinct keys comes as a row of chunk -1.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, flags, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "flags", "body"))):
                keys, counts = keyer(*unpack(body), flags)
                counts, rows = counts.astype(np.uint32), list(by_bucket(keys, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([pack_keys(keys[a:b]) for _, a, b in rows], pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in rows], pa.binary())],
                    names=["bucket", "chunk", "keys", "counts"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "bucket"):
            bucket, chunks_ = group["bucket"][0].as_py(), group["chunk"].to_pylist()
            blobs = [unpack_keys(b) for b in group["keys"].to_pylist()]
            totals, owner = add_up(blobs, [np.frombuffer(b, np.uint32) for b in group["counts"].to_pylist()])
            out = (np.minimum(totals, (1 << 31) - 1).astype(np.uint32) << np.uint32(1)) | owner.astype(np.uint32)
            edges = np.cumsum([0, *(len(b) for b in blobs)]).tolist()
            payload = [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            if summary:
                payload.append(summary(np.concatenate(blobs)[owner], totals[owner]))
                chunks_ = [*chunks_, -1]
            n = len(chunks_)
            yield pa.RecordBatch.from_arrays([pa.array(chunks_, pa.int64()), pa.array([bucket] * n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_())), pa.array(payload, pa.binary())], names=["chunk", "bucket", "ids", "flags", "payload"])

    asked = chunks.select("chunk", "flags", "body").mapInArrow(ask, REQUEST)
    return asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answer, ANSWER)


def joined(rows: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(iterator of (chunk, ids, flags, data, offsets, payloads by bucket))``, in tasks by chunk.

    The rows are as ANSWER says; the one of bucket -1 holds the chunk's ids and texts.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in grouped(batches, "chunk"):
            body, *rest = group["payload"].to_pylist()  # bucket -1 comes first
            yield group["chunk"][0].as_py(), group["ids"][0].as_py(), group["flags"][0].as_py(), *unpack(body), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(join(batches))

    return rows.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, schema)


def with_answers(chunks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """As :func:`joined`, for what :func:`count_keys` gives: (..., totals, owner) of the chunk's keys."""
    bodies = chunks.select("chunk", F.lit(-1).alias("bucket"), "ids", "flags", F.col("body").alias("payload"))

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *row, payloads in rows:
            got = np.frombuffer(b"".join(payloads), np.uint32)
            yield *row, (got >> np.uint32(1)).astype(np.int64), (got & np.uint32(1)).astype(bool)

    return joined(bodies.unionByName(answers.where("chunk >= 0")), lambda rows: finish(split(rows)), schema)
