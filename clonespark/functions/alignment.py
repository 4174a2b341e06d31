"""Banded affine local alignment of many short pairs at once (numpy), and projections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = -3
    gap_open: int = -5  # cost of the first gap base
    gap_extend: int = -1


ALIGNMENT_TYPE = (
    "score int, query_start int, query_end int, reference_start int, reference_end int, "
    "aligned_query string, aligned_reference string, matches int, mismatches int, insertions int, deletions int"
)

_CODE = np.full(256, 4, dtype=np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i
_PAD = 5


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]


def align_chunk(queries: list[str], references: list[str], diagonals: list[int], band: int, s: Scoring) -> list[tuple]:
    """Best local alignment of each pair inside its diagonal band.

    The table advances one query base at a time for all pairs together. A deletion
    chain along a row is a running maximum. Ties prefer substitution, insertion,
    deletion, then the earliest end.
    """
    count, width = len(queries), 2 * band + 1
    longest = max(map(len, queries))
    refs = max(map(len, references))
    q = np.full((count, longest), _PAD, dtype=np.int8)
    margin = band + 2
    low = max(0, max(diagonals)) + margin
    r = np.full((count, low + refs + longest + margin + max(0, -min(diagonals)) + width), _PAD, dtype=np.int8)
    for i, (a, b) in enumerate(zip(queries, references, strict=True)):
        q[i, : len(a)] = _codes(a)
        r[i, low : low + len(b)] = _codes(b)
    diag = np.array(diagonals)[:, None]
    offsets = np.arange(width)[None, :]
    floor = np.int32(-(1 << 28))
    score = np.zeros((count, width), dtype=np.int32)
    insert = np.full((count, width), floor)
    trace = np.zeros((longest, count, width), dtype=np.uint8)
    best, best_i, best_o = np.zeros(count, np.int32), np.zeros(count, int), np.zeros(count, int)
    steps = s.gap_extend * np.arange(width, dtype=np.int32)[None, :]
    edge = np.full((count, 1), floor, dtype=np.int32)
    # rows whose band misses every reference hold no cell
    top_row = max(1, min(diagonals) - band)
    last_row = min(longest, max(d + len(b) for d, b in zip(diagonals, references, strict=True)) + band)
    for i in range(top_row, last_row + 1):
        column = i - diag - band + offsets  # 1-based reference column
        base = np.take_along_axis(r, np.clip(column - 1 + low, 0, r.shape[1] - 1), axis=1)
        read = q[:, i - 1][:, None]
        inside = (base != _PAD) & (read != _PAD)
        gain = np.where((base < 4) & (read < 4), np.where(base == read, s.match, s.mismatch), 0)
        above = np.concatenate([score[:, 1:], np.zeros((count, 1), np.int32)], axis=1) + s.gap_open
        longer = np.concatenate([insert[:, 1:], edge], axis=1) + s.gap_extend
        insert_extends = longer > above
        insert = np.where(inside, np.maximum(longer, above), floor)
        substitution = score + gain
        direction = np.where(substitution > 0, 1, 0).astype(np.uint8)
        value = np.maximum(substitution, 0)
        better = insert > value
        direction[better], value = 2, np.where(better, insert, value)
        value = np.where(inside, value, 0)
        peak = np.maximum.accumulate(value - steps, axis=1)
        delete = np.full((count, width), floor)
        delete[:, 1:] = peak[:, :-1] + s.gap_open + steps[:, :-1]
        better = inside & (delete > value)
        final = np.where(better, delete, value)
        direction[better] = 3
        before = np.concatenate([np.zeros((count, 1), np.int32), final[:, :-1]], axis=1) + s.gap_open
        chained = np.concatenate([edge, delete[:, :-1]], axis=1) + s.gap_extend
        direction[~inside] = 0
        trace[i - 1] = direction | (insert_extends.astype(np.uint8) << 2) | ((chained > before).astype(np.uint8) << 3)
        score = np.where(inside, final, 0).astype(np.int32)
        top = score.argmax(axis=1)
        reached = score[np.arange(count), top]
        improved = reached > best
        best = np.where(improved, reached, best)
        best_i, best_o = np.where(improved, i, best_i), np.where(improved, top, best_o)

    results = []
    for p in range(count):
        if best[p] <= 0:
            results.append((0, 0, 0, 0, 0, "", "", 0, 0, 0, 0))
            continue
        a, b = queries[p], references[p]
        i, o = int(best_i[p]), int(best_o[p])
        end_i, end_j = i, i - diagonals[p] - band + o
        j, state = end_j, 0
        top_line: list[str] = []
        bottom_line: list[str] = []
        while i > 0 and j > 0 and 0 <= o < width:
            cell = int(trace[i - 1, p, o])
            if state == 0:
                move = cell & 3
                if move == 0:
                    break
                if move == 1:
                    top_line.append(a[i - 1])
                    bottom_line.append(b[j - 1])
                    i, j = i - 1, j - 1
                else:
                    state = move
            elif state == 2:
                top_line.append(a[i - 1])
                bottom_line.append("-")
                state = 2 if cell & 4 else 0
                i, o = i - 1, o + 1
            else:
                top_line.append("-")
                bottom_line.append(b[j - 1])
                state = 3 if cell & 8 else 0
                j, o = j - 1, o - 1
        query, reference = "".join(reversed(top_line)), "".join(reversed(bottom_line))
        matches = sum(x == y and x in "ACGT" for x, y in zip(query, reference, strict=True))
        insertions, deletions = reference.count("-"), query.count("-")
        results.append(
            (int(best[p]), i, end_i, j, end_j, query, reference, matches, len(query) - matches - insertions - deletions, insertions, deletions)
        )
    return results


def local_alignment(scoring: Scoring, chunk: int = 256):
    """UDF (query, reference, diagonal, band) -> alignment struct.

    Pairs of a batch are sorted by band and length so that padded tables stay small.
    """

    @F.pandas_udf(ALIGNMENT_TYPE)
    def align(query: pd.Series, reference: pd.Series, diagonal: pd.Series, band: pd.Series) -> pd.DataFrame:
        order = sorted(range(len(query)), key=lambda k: (band.iloc[k], diagonal.iloc[k], len(query.iloc[k])))
        out: list[tuple] = [()] * len(query)
        for begin in range(0, len(order), chunk):
            picked = order[begin : begin + chunk]
            rows = align_chunk(
                [query.iloc[k] for k in picked], [reference.iloc[k] for k in picked], [int(diagonal.iloc[k]) for k in picked],
                int(max(band.iloc[k] for k in picked)), scoring,
            )
            for k, row in zip(picked, rows, strict=True):
                out[k] = row
        return pd.DataFrame(out, columns=[f.split()[0] for f in ALIGNMENT_TYPE.split(", ")])

    return align.asNondeterministic()


def map_reference(aligned_query: Column, aligned_reference: Column, query_start: Column, reference_start: Column, position: Column) -> Column:
    """0-based query position aligned to a 0-based reference position, else NULL."""
    cells = F.zip_with(F.split(aligned_query, ""), F.split(aligned_reference, ""), lambda q, r: F.struct(q.alias("q"), r.alias("r")))
    folded = F.aggregate(
        cells,
        F.struct(query_start.cast("int").alias("i"), reference_start.cast("int").alias("j"), F.lit(None).cast("int").alias("hit")),
        lambda s, c: F.struct(
            (s["i"] + (c["q"] != "-").cast("int")).alias("i"),
            (s["j"] + (c["r"] != "-").cast("int")).alias("j"),
            F.coalesce(s["hit"], F.when((c["r"] != "-") & (s["j"] == position) & (c["q"] != "-"), s["i"])).alias("hit"),
        ),
    )
    # without gaps the projection is an offset
    plain = ~F.contains(aligned_query, F.lit("-")) & ~F.contains(aligned_reference, F.lit("-"))
    inside = (position >= reference_start) & (position < reference_start + F.length(F.translate(aligned_reference, "-", "")))
    return F.when(inside & plain, (query_start + position - reference_start).cast("int")).when(inside, folded["hit"])


# Extreme-value parameters (lambda, K, alpha, beta) per scoring scheme
# (match, mismatch, gap open, gap extend).
EVALUE_PARAMETERS = {
    (2, -3, -5, -1): (0.615091626817, 0.657543879520, 2.29229884023, -9.32267423552),
    (2, -3, -13, -1): (0.633731436761, 0.382178144270, 0.383131230945, 0.317757738848),
    (2, -3, -17, -2): (0.633731436761, 0.381864932099, 0.379080052598, 0.341396551998),
    (2, -4, -11, -1): (0.645352027689, 0.280867618578, 0.230455684630, -3.33906776426),
    (2, -4, -13, -1): (0.645457954698, 0.281099152429, 0.231233105738, -3.35008024475),
}


def alignment_evalue(scoring: Scoring):
    """UDF (score, query length, database bases, database sequences) -> E-value."""
    parameters = EVALUE_PARAMETERS.get((scoring.match, scoring.mismatch, scoring.gap_open, scoring.gap_extend))

    @F.pandas_udf("double")
    def evalue(score: pd.Series, length: pd.Series, bases: pd.Series, sequences: pd.Series) -> pd.Series:
        if parameters is None:
            return pd.Series(np.full(len(score), np.nan))
        rate, k, alpha, beta = parameters
        s, m, n, c = (x.to_numpy(float) for x in (score, length, bases, sequences))
        usable = (s > 0) & (m > 0) & (n > 0) & (c > 0)
        upper = np.maximum(0, np.minimum(m - 1, (n - c) / np.where(c > 0, c, 1)))
        a = np.zeros_like(m)
        for _ in range(64):
            area = np.maximum(1.0, (m - a) * (n - c * a))
            target = np.clip(alpha / rate * (np.log(k) + np.log(area)) + beta, 0, upper)
            if np.all(np.abs(target - a) < 1e-10):
                a = target
                break
            a = 0.5 * (a + target)
        a = np.where((m <= 1) | (n <= c), 0, a)
        value = np.log(k) + np.log(np.maximum(1, m - a)) + np.log(np.maximum(1, n - c * a)) - rate * s
        return pd.Series(np.where(usable, np.exp(np.clip(value, -745, 709)), np.nan))

    return evalue
