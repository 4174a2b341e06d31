"""Vectorised text kernels: words, hashes and runs over the bytes of an Arrow text column.

Everything here works on flat numpy arrays over a batch of texts and never on single
rows. Hashes are 64 bits wide and do not depend on batch, partition or session.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = values.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` odd multipliers that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags with the given inclusive byte ranges set."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(11, 256)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.cast(pa.large_binary()).fill_null(b"")
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """Words of a batch: byte bounds, and the number of the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def positions(self) -> np.ndarray:
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return segment_hashes(self.data, self.starts, self.ends, seed)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte segment (segments ascend and do not overlap), some blocks at a time."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    lengths = ends - starts
    place = stream(seed + 101, int(lengths.max()))
    summed = np.concatenate([[0], np.cumsum(lengths)])
    begin = 0
    while begin < len(starts):
        stop = max(begin + 1, int(np.searchsorted(summed, summed[begin] + BLOCK, "right")) - 1)
        own = lengths[begin:stop]
        heads = summed[begin:stop] - summed[begin]
        within = np.arange(int(own.sum())) - np.repeat(heads, own)
        values = _BYTE[data[np.repeat(starts[begin:stop], own) + within]] * place[within]
        full = own > 0
        if full.any():
            part = np.zeros(stop - begin, U)
            part[full] = np.add.reduceat(values, heads[full])
            out[begin:stop] = part
        begin = stop
    return mix(out + lengths.astype(U))


def words_of(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = BLANKS, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = lower_ascii(data)
    return words_in(data, offsets, separators)


def words_in(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> Words:
    inside = ~separators[data]
    starts, ends = runs(inside, offsets)
    return Words(data, starts, ends, np.searchsorted(starts, offsets).astype(np.int64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of true values; a run ends where a row ends."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last ``n - 1`` positions have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    factors = stream(seed + 977 * n, n)
    total = hashes[:size] * factors[0]
    for k in range(1, n):
        total += hashes[k : k + size] * factors[k]
    return mix(total)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words at which a window of ``n`` words of one row starts."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left >= n


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and the number of the key at each place."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    arranged = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = arranged[1:] != arranged[:-1]
    heads = np.flatnonzero(new)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return arranged[heads], np.minimum.reduceat(order, heads), inverse


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Flags of the positions inside any window of ``n`` that begins at ``starts``."""
    marks = np.zeros(size + 1, np.int32)
    ends = np.minimum(starts + n, size)
    marks += np.bincount(starts, minlength=size + 1)[: size + 1].astype(np.int32)
    marks -= np.bincount(ends, minlength=size + 1)[: size + 1].astype(np.int32)
    return np.cumsum(marks[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the words of each row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch at row bounds into pieces of about ``limit`` bytes of text (a longer text is one piece)."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, "right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop
