"""Blocks of documents and the exchange between blocks and hash ranges.

An operator that needs something from the whole corpus for every word, n-gram or passage would
shuffle one row for each occurrence if written with explode and join. Here the occurrences of a
block (the documents of a scan task, some 24 MB of text) are first reduced to its distinct keys; these
travel to the hash range that owns them, are answered there once, and the answers travel back to
the block. A key of a third of all rows costs one entry a block. Blocks are rows of a stored
table, so a lost task or executor repeats one block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of text in a block, from which on a block is closed.
BLOCK = 24 << 20
#: Bytes of stored input for each hash range, and most ranges.
RANGE, MOST_RANGES = 8 << 20, 1 << 16
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the types in ARROW."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def shut(value: object) -> bytes:
    """A compressed blob of arrays, bytes and plain values."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def opened(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  written by shut() in the same run


def planes(values: np.ndarray, width: int) -> bytes:
    """Integers as byte planes of the lowest ``width`` bytes, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.view("<u8").ravel()


def steps(ascending: np.ndarray, width: int) -> bytes:
    """Ascending unsigned integers as planes of their differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)), width)


def unsteps(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(unplanes(data, width), dtype=np.uint64)


def ranges(df: DataFrame) -> int:
    """How many hash ranges suit ``df``: a power of two that follows the size that the optimizer knows.

    Where it knows none (it then says exabytes), the session's shuffle partitions count.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 55:
        size = RANGE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 8
    while n < min(MOST_RANGES, size // RANGE):
        n *= 2
    return n


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows, of about ``limit`` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str, list, np.ndarray)))
        if size >= limit or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def scanned(docs: DataFrame, fn: Callable[[int, list, list[bytes]], Iterable[tuple]], schema: str, limit: int = BLOCK) -> DataFrame:
    """Apply fn(block, ids, texts) to blocks of docs(doc_id, text), closed at ``limit`` bytes; a null text is empty.

    Block numbers are unique in the result, which must be stored before it is read twice.
    """
    own = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")
    to = arrow(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def rows() -> Iterator[tuple]:
            nonlocal block, ids, texts, size
            for batch in stream:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(doc_id)
                    texts.append(text.as_py() or b"")
                    size += len(texts[-1])
                    if size >= limit:
                        yield from fn(block, ids, texts)
                        block, ids, texts, size = block + 1, [], [], 0
            if ids:
                yield from fn(block, ids, texts)

        yield from batches(rows(), to)

    return own.mapInArrow(run, schema)


def mapped(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply fn to the values of every row."""
    to = arrow(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for batch in stream for i in range(batch.num_rows) for row in fn(*(c[i].as_py() for c in batch.columns))), to)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: str, fn: Callable[[int, pa.Table], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply fn(key, rows) to the rows of every key; the rows of a key are blobs of a bounded total."""
    to = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(batches(fn(table.column(key)[0].as_py(), table), to), to)

    return df.groupBy(key).applyInArrow(run, schema)


def met(one: DataFrame, other: DataFrame, key: str, fn: Callable[[int, pa.Table, pa.Table], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply fn(key, rows of one, rows of other) to every key of ``one``."""
    to = arrow(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = fn(a.column(key)[0].as_py(), a, b) if a.num_rows else ()
        return pa.Table.from_batches(batches(rows, to), to)

    return one.groupBy(key).cogroup(other.groupBy(key)).applyInArrow(run, schema)
