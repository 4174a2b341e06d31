"""Arrow UDFs for the few per-row computations Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eight sketch seeds and the hash constants; sketches built
# with them compare equal to sketches stored by other tools of this family.
SKETCH_SEEDS = (
    0x811C9DC5, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646C, 0xFD7046C5,
)
HASH_PRIME = 0x01000193
MIX_FIRST = 0x7FEB352D
MIX_SECOND = 0x846CA68B
EMPTY_SLOT = 0xFFFFFFFF
SKETCH_KMER = 7


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window under every seed, as (seeds, windows) uint32."""
    windows = len(codes) - width + 1
    state = np.repeat(np.array(SKETCH_SEEDS, dtype=np.uint32)[:, None], windows, axis=1)
    with np.errstate(over="ignore"):
        for offset in range(width):
            state ^= codes[offset : offset + windows].astype(np.uint32)
            state *= np.uint32(HASH_PRIME)
        state ^= state >> np.uint32(16)
        state *= np.uint32(MIX_FIRST)
        state ^= state >> np.uint32(15)
        state *= np.uint32(MIX_SECOND)
        state ^= state >> np.uint32(16)
    return state


def sketch_of(sequence: str, k: int = SKETCH_KMER) -> list[int]:
    """Eight minimum hashes over the k-mers of a normalised sequence without N."""
    codes = np.frombuffer(sequence.replace("N", "").encode("ascii"), dtype=np.uint8)
    if not len(codes):
        return [EMPTY_SLOT] * len(SKETCH_SEEDS)
    return _window_hashes(codes, max(1, min(k, len(codes)))).min(axis=1).astype(np.int64).tolist()


#: Letters that are hashed at once, few enough to stay in a core's cache.
HASHED = 1 << 16


def sketches_of(sequences: list[str]) -> np.ndarray:
    """``sketch_of`` many sequences, as (sequences, seeds)."""
    clean = [s.replace("N", "") for s in sequences]
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    out = np.full((len(clean), len(SKETCH_SEEDS)), EMPTY_SLOT, np.int64)
    for i in np.flatnonzero((lengths > 0) & (lengths < SKETCH_KMER)):
        out[i] = sketch_of(clean[i])
    usable = np.flatnonzero(lengths >= SKETCH_KMER)
    part = np.cumsum(lengths[usable]) // HASHED
    for rows in np.split(usable, np.flatnonzero(np.diff(part)) + 1):
        if not len(rows):
            continue
        codes = np.frombuffer("".join([clean[i] for i in rows]).encode("ascii"), dtype=np.uint8)
        ends = np.cumsum(lengths[rows])
        hashes = _window_hashes(codes, SKETCH_KMER)
        for back in range(1, SKETCH_KMER):  # windows that reach into the next sequence
            hashes[:, ends[:-1] - back] = EMPTY_SLOT
        out[rows] = np.minimum.reduceat(hashes, np.concatenate(([0], ends[:-1])), axis=1).T
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def minhash_sketch(sequence: pa.Array) -> pa.Array:
    """MinHash sketch of normalised nucleotide text (see ``normalize_nt``)."""
    found = sketches_of([s or "" for s in sequence.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(SKETCH_SEEDS), pa.int32()), pa.array(found.ravel()))


def sketch_similarity(left: Column, right: Column) -> Column:
    """Equal slots over slots that are informative on either side."""
    empty = F.lit(EMPTY_SLOT)
    informative = F.zip_with(left, right, lambda a, b: F.when((a == empty) & (b == empty), 0).otherwise(1))
    equal = F.zip_with(left, right, lambda a, b: F.when((a == b) & (a != empty), 1).otherwise(0))
    n = F.aggregate(informative, F.lit(0), lambda s, x: s + x)
    m = F.aggregate(equal, F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, m / n).otherwise(0.0)


def edit_profile_of(parent: str, child: str, maximum: int) -> tuple[int, int, int, int] | None:
    """(distance, substitutions, insertions, deletions) of the best alignment.

    Among equally short alignments the one with fewest indels wins, then fewest
    substitutions, then fewest deletions. Each cell is one comparable tuple, so
    the preference order is the tuple order.
    """
    if abs(len(parent) - len(child)) > maximum:
        return None
    # (cost, indels, substitutions, deletions)
    row = {column: (column, column, 0, 0) for column in range(0, min(len(child), maximum) + 1)}
    for i, base in enumerate(parent, start=1):
        current: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i - maximum), min(len(child), i + maximum) + 1):
            options = []
            diagonal = row.get(j - 1) if j > 0 else None
            if diagonal is not None:
                miss = 0 if base == child[j - 1] else 1
                options.append((diagonal[0] + miss, diagonal[1], diagonal[2] + miss, diagonal[3]))
            above = row.get(j)
            if above is not None:
                options.append((above[0] + 1, above[1] + 1, above[2], above[3] + 1))
            left = current.get(j - 1)
            if left is not None:
                options.append((left[0] + 1, left[1] + 1, left[2], left[3]))
            if options:
                best = min(options)
                if best[0] <= maximum:
                    current[j] = best
        if not current:
            return None
        row = current
    best = row.get(len(child))
    if best is None:
        return None
    cost, indels, substitutions, deletions = best
    return cost, substitutions, indels - deletions, deletions


EDIT_PROFILE_TYPE = "distance int, substitutions int, insertions int, deletions int"


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat letters of all texts, first letter and length of each."""
    flat = texts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    if len(data) and data[offsets[0] : offsets[-1]].max(initial=0) > 127:
        length = np.array([len(t) for t in texts.to_pylist()], np.int64)
        return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), np.cumsum(length) - length, length
    return data, offsets[:-1], np.diff(offsets)


def _agreeing(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many letters agree from two places on, at most ``room``, going by ``step``."""
    count = np.zeros(len(room), np.int64)
    open_rows = np.flatnonzero(room > 0)
    width = 8
    while len(open_rows):
        # as many letters at once as the last round found agreeing; the first letter that differs ends a row
        at = step * (count[open_rows][:, None] + np.arange(width))
        inside = np.abs(at) < room[open_rows][:, None]
        x = a[np.where(inside, from_a[open_rows][:, None] + at, 0)]
        y = b[np.where(inside, from_b[open_rows][:, None] + at, 0)]
        same = np.logical_and.accumulate((x == y) & inside, axis=1)
        count[open_rows] += same.sum(axis=1)
        open_rows = open_rows[same[:, -1] & (count[open_rows] < room[open_rows])]
        width = min(2 * width, 64)
    return count


#: Pairs whose profiles are computed at once.
PROFILE_ROWS = 4096


def edit_distances(left: pa.Array, right: pa.Array, limit: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each pair, -1 above its limit.

    For 0, 1, 2, ... edits every diagonal keeps the furthest place of the left text that so many edits reach. Only diagonals
    from which the edits left over lead to the end of both texts are followed.
    """
    a, start_a, length_a = _letters(left)
    b, start_b, length_b = _letters(right)
    out = np.full(len(limit), -1, np.int64)
    rows = np.flatnonzero(np.abs(length_b - length_a) <= limit)
    most = int(limit[rows].max(initial=0))
    never = np.int64(-(1 << 40))
    # one column more on either side, which is never reached
    reach = np.full((2 * most + 3, len(rows)), never)
    for edits in range(most + 1):
        new = np.full_like(reach, never)
        n_a, n_b, left_over = length_a[rows], length_b[rows], limit[rows] - edits
        for d in range(-edits, edits + 1):
            at = d + most + 1
            if edits:
                i = np.maximum(np.maximum(reach[at] + 1, reach[at - 1]), reach[at + 1] + 1)
                i = np.minimum(np.minimum(i, n_a), n_b - d)
            else:
                i = np.zeros(len(rows), np.int64)
            on = np.flatnonzero((i >= 0) & (i + d >= 0) & (np.abs(n_b - n_a - d) <= left_over))
            i = i[on]
            from_a, from_b = start_a[rows[on]] + i, start_b[rows[on]] + i + d
            new[at, on] = i + _agreeing(a, b, from_a, from_b, np.minimum(n_a[on] - i, n_b[on] - i - d), 1)
        ended = new[n_b - n_a + most + 1, np.arange(len(rows))] == n_a
        out[rows[ended]] = edits
        open_rows = ~ended & (left_over > 0)
        rows, reach = rows[open_rows], new[:, open_rows]
    return out


def edit_profiles(parents: pa.Array, children: pa.Array, maximum: int) -> np.ndarray:
    """``edit_profile_of`` of many pairs, one row of four numbers each, -1 beyond ``maximum`` edits.

    What agrees at both ends is left out: some best alignment pairs it letter by letter. The rest goes through the same
    band of cells for all pairs together. A cell is one number, whose digits are cost, indels, substitutions
    and deletions, so that the preference order is the order of numbers.
    """
    out = np.full((len(parents), 4), -1, np.int64)
    a, start_a, length_a = _letters(parents)
    b, start_b, length_b = _letters(children)
    near = np.flatnonzero(np.abs(length_a - length_b) <= maximum)
    start_a, length_a, start_b, length_b = start_a[near], length_a[near], start_b[near], length_b[near]
    shorter = np.minimum(length_a, length_b)
    front = _agreeing(a, b, start_a, start_b, shorter, 1)
    back = _agreeing(a, b, start_a + length_a - 1, start_b + length_b - 1, shorter - front, -1)
    start_a, start_b = start_a + front, start_b + front
    length_a, length_b = length_a - front - back, length_b - front - back
    digit = maximum + 2
    unit = digit**3
    beyond = np.int64(digit * unit)
    miss, insertion, deletion = unit + digit, unit + digit**2, unit + digit**2 + 1
    order = np.argsort(length_a, kind="stable")
    a, b = (np.append(x, x.dtype.type(0)) for x in (a, b))
    for low in range(0, len(order), PROFILE_ROWS):
        rows = order[low : low + PROFILE_ROWS]
        n_a, n_b, at_a, at_b = length_a[rows], length_b[rows], start_a[rows], start_b[rows]
        # cell[d] is column j = i + d - maximum of the current letter i of the parent
        width = 2 * maximum + 1
        cell = np.full((width, len(rows)), beyond)
        for j in range(maximum + 1):
            cell[maximum + j] = np.where(j <= n_b, j * insertion, beyond)
        for i in range(1, int(n_a.max(initial=0)) + 1):
            going = i <= n_a
            base = a[np.where(going, at_a + i - 1, 0)]
            new = np.full_like(cell, beyond)
            for d in range(width):
                j = i + d - maximum
                if j < 0:
                    continue
                best = cell[d + 1] + deletion if d + 1 < width else np.full(len(rows), beyond)
                if j > 0:
                    other = b[np.where(j <= n_b, at_b + j - 1, len(b) - 1)]
                    best = np.minimum(best, cell[d] + np.where(base == other, 0, miss))
                    if d:
                        best = np.minimum(best, new[d - 1] + insertion)
                new[d] = np.where((j <= n_b) & (best < (maximum + 1) * unit), best, beyond)
            cell = np.where(going, new, cell)
        last = cell[n_b - n_a + maximum, np.arange(len(rows))]
        cost, rest = np.divmod(last, unit)
        indels, rest = np.divmod(rest, digit**2)
        substitutions, deletions = np.divmod(rest, digit)
        done = np.stack([cost, substitutions, indels - deletions, deletions], axis=1)
        out[near[rows]] = np.where((last < beyond)[:, None], done, -1)
    return out


def edit_profile(maximum: int):
    """UDF (parent, child) -> profile struct, all NULL beyond ``maximum`` edits."""
    if not 0 <= maximum <= 8:
        raise ValueError("the edit radius must be between 0 and 8")

    @F.pandas_udf(EDIT_PROFILE_TYPE)
    def profile(parent: pd.Series, child: pd.Series) -> pd.DataFrame:
        rows = edit_profiles(pa.array(parent.fillna(""), pa.string()), pa.array(child.fillna(""), pa.string()), maximum)
        frame = pd.DataFrame(rows, columns=["distance", "substitutions", "insertions", "deletions"]).astype("Int32")
        return frame.mask(frame["distance"] < 0)

    return profile.asNondeterministic()


@F.pandas_udf(T.IntegerType())
def edit_distance_wildcard(left: pd.Series, right: pd.Series) -> pd.Series:
    """Levenshtein distance in which N matches any base.

    The inner loop over one row of the table is replaced by a running minimum:
    an insertion chain ending at column j costs ``min_k(t[k] - k) + j``.
    """

    def distance(a: str, b: str) -> int:
        if not a or not b:
            return max(len(a), len(b))
        target = np.frombuffer(b.encode("ascii"), dtype=np.uint8)
        wild = target == ord("N")
        steps = np.arange(len(target) + 1)
        row = steps.copy()
        for i, base in enumerate(a.encode("ascii"), start=1):
            miss = np.zeros(len(target), int) if base == ord("N") else ((target != base) & ~wild).astype(int)
            candidate = np.empty_like(row)
            candidate[0] = i
            candidate[1:] = np.minimum(row[1:] + 1, row[:-1] + miss)
            row = np.minimum.accumulate(candidate - steps) + steps
        return int(row[-1])

    return pd.Series([distance(a, b) for a, b in zip(left.fillna(""), right.fillna(""), strict=True)])


TRIM_TYPE = "trimmed_length int, expected_errors double"


def three_prime_trim(offset: int = 33, window: int = 4, minimum_mean: float = 20.0, enabled: bool = True):
    """UDF quality -> (kept length, expected errors of the kept part).

    From the 3' end, bases go while the mean Phred of the last ``window`` kept
    bases is below the floor; prefix sums give every window mean at once.
    """

    @F.pandas_udf(TRIM_TYPE)
    def trim(quality: pd.Series) -> pd.DataFrame:
        rows = []
        for q in quality.fillna(""):
            codes = np.frombuffer(q.encode("ascii"), dtype=np.uint8).astype(np.int64)
            if len(codes) and (codes.min() < offset or codes.max() > 126):
                raise ValueError(f"FASTQ quality character outside the Phred+{offset} range")
            phred = codes - offset
            keep = len(phred)
            if enabled and keep:
                prefix = np.concatenate(([0], np.cumsum(phred)))
                ends = np.arange(1, keep + 1)
                starts = np.maximum(0, ends - max(1, window))
                passing = np.flatnonzero(prefix[ends] - prefix[starts] >= minimum_mean * (ends - starts))
                keep = int(passing[-1] + 1) if len(passing) else 0
            rows.append((keep, float(np.power(10.0, -phred[:keep] / 10.0).sum())))
        return pd.DataFrame(rows, columns=["trimmed_length", "expected_errors"])

    return trim.asNondeterministic()
