"""Questions that chunks of documents ask about their keys, answered without gathering anything in one place.

A chunk is a row that holds some documents. It sorts its distinct keys, numbers of 64 bits spread evenly, and sends each
stretch of them to the bucket of that stretch, delta-coded and compressed. A bucket sees all chunks' keys of its stretch
and answers each chunk in the chunk's own order. A key, however frequent, comes once from each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinmatch.llm.common import text_slices

ASKS = "chunk bigint, bucket int, keys binary, told binary"
#: Keys that only say where to look are cut to their first 48 bits.
SHORT = ~np.uint64(0xFFFF)
ANSWERS = "chunk bigint, bucket int, told binary"
#: ids, digests and sizes of the rows; more: what else was worked out; payload: the rows themselves. A chunk is numbered
#: by the partition that it was read from and its place there, in the last 24 bits.
CHUNK = "chunk bigint, n_bytes bigint, ids binary, digests binary, sizes binary, more binary, payload binary"


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, with their type."""
    kind = x.dtype.str.encode().ljust(4)
    return kind + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(x: bytes) -> np.ndarray:
    kind = np.dtype(x[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_all(arrays: Sequence[np.ndarray]) -> bytes:
    parts = [pack(x) for x in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpack_all(x: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(x, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(x, "<i8", n, 8))
    return [unpack(x[a:b]) for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def asks(chunk: int, buckets: int, keys: np.ndarray, columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Rows of ASKS. keys: in order (equal ones are told apart by columns); columns: what goes with each."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    filled, begin = np.unique(bucket, return_index=True)
    bounds = list(zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]))
    return pa.record_batch([
        pa.array(np.full(len(filled), chunk, np.int64)), pa.array(filled.astype(np.int32)),
        pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in bounds], pa.binary()), pa.array([pack_all([c[a:b] for c in columns]) for a, b in bounds], pa.binary()),
    ], names=["chunk", "bucket", "keys", "told"])


def answered(asked: DataFrame, answer: Callable[..., np.ndarray]) -> DataFrame:
    """ANSWERS: answer(keys, *columns) of all rows of a bucket together gives a number for each."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        columns = [np.concatenate(x) for x in zip(*(unpack_all(x) for x in table.column("told").to_pylist()))]
        parts = np.split(answer(np.concatenate(keys), *columns), np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "told": pa.array([pack(x) for x in parts], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


def totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum over all chunks of each key's numbers."""
    _, each = np.unique(keys, return_inverse=True)
    return np.minimum(np.bincount(each, n), 2**31).astype(np.uint32)[each]


def is_first(keys: np.ndarray, check: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row has the least place (most important number first) of those with its key and check."""
    order = np.lexsort((*reversed(place), check, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(check[order].astype(np.int64)) != 0)
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), bool)
    out[order] = np.logical_and.reduce([x[order] == x[lead] for x in place])
    return out


def answer_of(right: pa.Table, kind: type) -> np.ndarray:
    """A chunk's answers, in the order of its keys."""
    parts = right.sort_by("bucket").column("told").to_pylist()
    return np.concatenate([unpack(x) for x in parts]) if parts else np.zeros(0, kind)


class FirstAsk:
    """A chunk's question which of its keys are first: one row for each distinct key and check, with its least place there."""

    def __init__(self, keys: np.ndarray, check: np.ndarray, *place: np.ndarray):
        order = np.lexsort((*reversed(place), check, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])
        self.lead = order[new]
        self.each = np.empty(len(order), np.int64)
        self.each[order] = np.cumsum(new) - 1
        self.keys, self.check, self.place = keys, check, place

    def asks(self, chunk: int, buckets: int) -> pa.RecordBatch:
        at = self.lead
        return asks(chunk, buckets, self.keys[at], [self.check[at], *(x[at] for x in self.place)])

    def firsts(self, answer: np.ndarray) -> np.ndarray:
        """Whether each row is first, by what came back."""
        lead = self.lead[self.each]
        return np.logical_and.reduce([answer.astype(bool)[self.each], *(x == x[lead] for x in self.place)])


def chunks_of(docs: DataFrame, id_col: str, text_col: str, more: Callable[[list[bytes]], bytes] = lambda texts: b"") -> DataFrame:
    """Rows of CHUNK: about 8 MB of documents each, whole rows packed as they are, and more(texts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        for part in text_slices(batches, text_col):
            texts = [(x or "").encode() for x in part.column(text_col).to_pylist()]
            ids = pc.fill_null(part.column(id_col).cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(part)
            digests = b"".join(hashlib.sha256(x).digest() for x in texts)
            sizes = np.array([len(x) for x in texts], np.int64)
            packed = (pack(ids), digests, pack(sizes), more(texts), sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array([x], pa.int64()) for x in (number, int(sizes.sum()))] + [pa.array([x], pa.binary()) for x in packed], names=[x.split()[0] for x in CHUNK.split(", ")])
            number += 1

    return docs.mapInArrow(run, CHUNK)


def rows_of(payload: bytes) -> pa.RecordBatch:
    """The documents of a chunk. Buffers copied: the rows may outlive the message."""
    return pa.ipc.open_stream(payload).read_next_batch()


def per_chunk(fn):
    """fn(row of the chunk) -> record batches, over rows that are chunks."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from fn(batch.slice(at, 1).to_pylist()[0])

    return run


def with_answers(table: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(row of the chunk, what came back to it) -> table of the schema."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("answers for a chunk that is not there")
        out = fn(left.to_pylist()[0], right)
        return out if isinstance(out, pa.Table) else pa.table({c: pa.array([x]) for c, x in zip(names, out)})

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def texts_of(rows: pa.RecordBatch, text_col: str) -> list[bytes]:
    return [x or b"" for x in rows.column(text_col).cast(pa.binary()).to_pylist()]
