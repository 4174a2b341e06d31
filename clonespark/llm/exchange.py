"""Questions from document chunks to key buckets, and their answers.

Operators that compare every window of every text would shuffle one row per window.
Here a chunk of documents (a hash of the id, a bounded number of bytes) first reduces
its keys to distinct ones, and sends one packed row to each key bucket. A bucket sees a
key at most once from each chunk, however often it occurs in the corpus, so a passage
that a third of all documents share is no heavier than any other. The answers go back
in the order of the keys sent and need no keys of their own.

Numbers of chunks and buckets follow the counted bytes of the input. Keys travel in
ascending order as steps of about five bytes, which keep 56 bits of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
ROWS = "bucket int, chunk int, kind int, payload binary"
#: Bytes of text in a chunk, and bytes of text whose keys meet in one bucket.
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20


def spread(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Numbers of chunks and buckets for the counted bytes of ``docs``."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    return max(least, math.ceil(total / CHUNK_BYTES)), max(least, math.ceil(total / BUCKET_BYTES))


def chunked(docs: DataFrame, chunks: int, key: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """``(doc_id, text, chunk)`` and ``more``; rows of one id, null ids too, are in one chunk."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(-1))), F.lit(chunks)).cast("int").alias("chunk"),
        *[c.alias(name) for name, c in more.items()],
    )


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id (nulls last) and text: an order that does not depend on how the rows came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) * U(buckets)) >> U(32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind one another, with their kinds and lengths in front."""
    heads = [np.array([len(arrays)], np.int64)]
    for a in arrays:
        heads.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.int64))
    return b"".join([*(h.tobytes() for h in heads), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(payload: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    heads = np.frombuffer(payload, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for kind, width, size in heads.tolist():
        out.append(np.frombuffer(payload, np.dtype(f"{chr(kind)}{width}"), size, at))
        at += width * size
    return out


def pack_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The upper 56 bits of ascending keys: the first, and the steps in two columns.

    Steps are as wide as the keys of one chunk are dense, so about five bytes a key at any size.
    """
    keys = keys >> U(8)
    steps = np.diff(keys, prepend=keys[:1])
    high = steps >> U(32)
    most = int(high.max()) if len(high) else 0
    return keys[:1], steps.astype(np.uint32), high.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def read_keys(first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    steps = low.astype(U) | (high.astype(U) << U(32))
    return np.cumsum(steps, dtype=U) + first.astype(U) if len(first) else steps


def rows_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "kind", "payload"])


def groups_of(order_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of equal bucket in a sorted array of bucket numbers; empty buckets are left out."""
    bounds = np.searchsorted(order_keys, np.arange(buckets + 1, dtype=order_keys.dtype))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), slice(int(bounds[b]), int(bounds[b + 1]))
