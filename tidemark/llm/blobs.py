"""Column blobs: numpy columns and record batches packed into binary cells, dealt out by a key.

Rows of fixed-width numbers cost a few bytes each this way, where single Spark rows would cost tens.
A packed row is (key long, kind int, blob binary). All blobs of a key meet in one call of a function;
keys are chosen so that what meets is bounded by the input divided by the number of keys.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

DDL = "key long, kind int, blob binary"
SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of one length, as one compressed blob. Their types are the reader's business."""
    head = struct.pack(f">{len(columns) + 1}I", len(columns), *[c.nbytes for c in columns])
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join([np.ascontiguousarray(c).tobytes() for c in columns]))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack(">I", raw[:4])
    sizes = struct.unpack(f">{n}I", raw[4 : 4 + 4 * n])
    out, at = [], 4 + 4 * n
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def unpack_all(blobs: list[bytes], *types) -> list[np.ndarray]:
    """The blobs' columns, joined."""
    parts = [unpack(b, *types) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


def planes(x: np.ndarray, width: int) -> np.ndarray:
    """The `width` low bytes of integers, plane by plane: what varies little compresses apart from what varies much."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def from_planes(b: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = b.reshape(width, -1).T
    return out.view(np.uint64).ravel()


def pack_rows(batch: pa.RecordBatch, level: int = 5) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes())


def unpack_rows(blob: bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return pa.Table.from_batches(pa.ipc.open_stream(raw).read_all().to_batches()).combine_chunks().to_batches()[0]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], SCHEMA.field(k).type) for k in range(3)], schema=SCHEMA)


def packed_rows(df: DataFrame, key_of: Callable[[pa.RecordBatch], np.ndarray], kind: int = 0, most: int = 16_000_000) -> DataFrame:
    """df's rows as blobs by key, about `most` bytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            keys = key_of(whole)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else []
            for part in np.split(order, cuts[1:]) if len(order) else []:
                yield rows([(int(keys[part[0]]), kind, pack_rows(whole.take(pa.array(part))))])

        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from flush()
                size = 0
        yield from flush()

    return mapped(df, run, DDL)


def by_key(df: DataFrame, parts: int, fn: Callable[[int, dict[int, list[bytes]]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """fn(key, blobs by kind) for each key of a packed frame: one shuffle of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for key, kind, blob in zip(*[batch.column(k) for k in range(3)], strict=True):
                if (key := key.as_py()) != at:
                    if at is not None:
                        yield from fn(at, held)
                    at, held = key, {}
                held.setdefault(kind.as_py(), []).append(blob.as_py())
        if at is not None:
            yield from fn(at, held)

    # Keys are numbers from 0, dealt out evenly; hashed, some partitions would get several and others none.
    return mapped(df.repartitionById(parts, F.col("key").cast("int")).sortWithinPartitions("key", "kind"), run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
