"""Aligned texts of an Arrow batch as one flat array of letters, for the column tools that walk every letter.

A batch is taken up in pieces of a bounded number of letters, and every step is a step over a whole piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import CODON_TABLE

#: Letters of a piece; a longer text is a piece of its own.
PIECE = 1 << 20
GAP = ord("-")
_BASE_KINDS = 6  # A, C, G, T, gap, anything else
_WHOLE, _MIXED, _UNCLEAR, _STOP, _PLAIN = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each letter; kind, residue by column and residue by segment of each codon of three kinds."""
    letters = np.full(256, 5, np.uint8)
    for kind, letter in enumerate("ACGT-"):
        letters[ord(letter)] = kind
    kinds, columns, segments = [], [], []
    for codon in (a + b + c for a in "ACGT-?" for b in "ACGT-?" for c in "ACGT-?"):
        residue = CODON_TABLE.get(codon, "X")
        gaps = codon.count("-")
        kinds.append(_WHOLE if gaps == 3 else _MIXED if gaps else _UNCLEAR if "?" in codon else _STOP if residue == "*" else _PLAIN)
        columns.append(ord("-" if gaps == 3 else residue))
        segments.append(ord("-" if gaps else residue))
    return letters, np.array(kinds), np.array(columns, np.uint8), np.array(segments, np.uint8)


LETTER_KIND, CODON_KIND, COLUMN_RESIDUE, SEGMENT_RESIDUE = _tables()


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text starts, with one more entry for the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), starts


def unflat(codes: np.ndarray, starts: np.ndarray) -> list[str]:
    whole = codes.tobytes().decode("ascii" if codes.dtype == np.uint8 else "utf-32-le")
    at = starts.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def ends_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def dealt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and running number of each of ``counts`` entries per text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(ends_of(counts)[:-1], counts)


def pieces(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of rows of about ``PIECE`` letters, empty rows counted too."""
    part = ends_of(lengths + 1)[:-1] // PIECE
    cuts = np.flatnonzero(np.diff(part)) + 1
    at = [0, *cuts.tolist(), len(lengths)]
    yield from (slice(a, b) for a, b in zip(at, at[1:], strict=False))


def codons(codes: np.ndarray, starts: np.ndarray, offset: np.ndarray, partial: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codons from ``offset`` letters on: how many each text has, the owner of each, and its three kinds as one number."""
    counts = (np.maximum(np.diff(starts) - offset, 0) + (2 if partial else 0)) // 3
    owner, nth = dealt(counts)
    at = starts[:-1][owner] + offset[owner] + 3 * nth
    left = starts[1:][owner] - at
    kinds = np.append(LETTER_KIND[np.minimum(codes, 255)], np.full(3, 5, np.uint8)).astype(np.int64)
    second, third = np.where(left > 1, kinds[at + 1], 5), np.where(left > 2, kinds[at + 2], 5)
    return counts, owner, (kinds[at] * _BASE_KINDS + second) * _BASE_KINDS + third


def residues(texts: list[str], offset: np.ndarray, partial: bool, table: np.ndarray) -> list[str]:
    counts, _, codon = codons(*flat(texts), offset, partial)
    return unflat(table[codon], ends_of(counts))


def _by_pieces(texts: list[str], work: Callable[[slice], list]) -> list:
    out: list = []
    for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
        out += work(part)
    return out


def translation(table: np.ndarray, partial: bool):
    """UDF (text, offset) -> residues of the codons from ``offset`` on."""

    @F.arrow_udf(T.StringType())
    def translated(value: pa.Array, offset: pa.Array) -> pa.Array:
        texts, first = value.to_pylist(), offset.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(_by_pieces(texts, lambda p: residues(texts[p], first[p], partial, table)), pa.string())

    return translated


FRAME_COUNTS = ("complete_gap_codons", "mixed_gap_codons", "ambiguous_codons", "stop_codons")


@F.arrow_udf(T.StructType([T.StructField(f"{name}_{phase}", T.LongType()) for phase in range(3) for name in FRAME_COUNTS]))
def frame_counts(value: pa.Array) -> pa.Array:
    """Kinds of codons of an aligned text in each of the three phases."""
    texts = value.to_pylist()

    def count(part: slice) -> list[np.ndarray]:
        codes, starts = flat(texts[part])
        n, found = len(starts) - 1, []
        for phase in range(3):
            _, owner, codon = codons(codes, starts, np.full(n, phase), False)
            by_kind = np.bincount(owner * 5 + CODON_KIND[codon], minlength=5 * n).reshape(n, 5)
            found.append(by_kind[:, [_WHOLE, _MIXED, _UNCLEAR, _STOP]])
        return [np.hstack(found)]

    counts = np.vstack([np.zeros((0, 12), np.int64), *_by_pieces(texts, count)])
    names = [f"{name}_{phase}" for phase in range(3) for name in FRAME_COUNTS]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(counts[:, i])) for i in range(12)], names)


def motif_cover(motifs: list[list[str]], any_letter: str):
    """UDF text -> number of the first motif that covers each column, 0 where none does.

    A motif is one text of letters per place; ``any_letter`` stands for all but the line feed. Gaps are passed over.
    """
    allowed = []
    for motif in motifs:
        places = np.zeros((len(motif), 256), bool)
        for row, letters in zip(places, motif, strict=True):
            if letters == any_letter:
                row[:] = True
                row[ord("\n")] = False
            else:
                row[[ord(c) for c in letters]] = True
        allowed.append(places)

    def cover(texts: list[str]) -> np.ndarray:
        codes, starts = flat(texts)
        columns = np.flatnonzero(codes != GAP)
        query = np.minimum(codes[columns], 255)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))[columns]
        cells = np.zeros(len(codes), np.int32)
        for k in range(len(allowed) - 1, -1, -1):
            size = len(allowed[k])
            n = len(query) - size + 1
            if not size or n < 1:
                continue
            here = owner[:n] == owner[size - 1 :]
            for j in range(size):
                here &= allowed[k][j][query[j : j + n]]
            first = np.flatnonzero(here)
            for j in range(size):
                cells[columns[first + j]] = k + 1
        return cells

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(value: pa.Array) -> pa.Array:
        texts = value.to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        found = np.concatenate([np.zeros(0, np.int32), *[cover(texts[p]) for p in pieces(lengths)]])
        return pa.ListArray.from_arrays(pa.array(ends_of(lengths), pa.int32()), pa.array(found, pa.int32()))

    return cells


@F.arrow_udf(T.StringType())
def projected(clean: pa.Array, offset: pa.Array, protein: pa.Array) -> pa.Array:
    """Bases of ``clean`` behind the residues of ``protein``; what is missing of a codon is filled with ``-``."""
    dna, aligned, first = clean.to_pylist(), protein.to_pylist(), offset.to_numpy(zero_copy_only=False).astype(np.int64)

    def project(part: slice) -> list[str]:
        bases, at = flat(dna[part])
        letters, rows = flat(aligned[part])
        skip = first[part]
        size, width = np.diff(at), np.diff(rows)
        head = np.minimum(skip, size)
        kept = letters != GAP
        before = ends_of(kept)
        used = skip + 3 * (before[rows[1:]] - before[rows[:-1]])
        tail = np.maximum(size - used, 0)
        lead, rest = (np.where((n > 0) & (n < 3), 3, n) for n in (head, tail))
        starts = ends_of(lead + 3 * width + rest)
        out = np.full(starts[-1], GAP, np.uint32)

        def place(counts: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
            owner, nth = dealt(counts)
            out[target[owner] + nth] = bases[source[owner] + nth]

        place(head, at[:-1], starts[:-1])
        place(tail, at[:-1] + used, starts[:-1] + lead + 3 * width)
        column = np.flatnonzero(kept)
        row = np.repeat(np.arange(len(width)), width)[column]
        nth = before[column] - before[rows[row]]
        source = at[row] + skip[row] + 3 * nth
        place(np.clip(at[row + 1] - source, 0, 3), source, starts[row] + lead[row] + 3 * (column - rows[row]))
        return unflat(out, starts)

    return pa.array(_by_pieces([d + a for d, a in zip(dna, aligned, strict=True)], project), pa.string())


@F.arrow_udf(T.StringType())
def taken(value: pa.Array, columns: pa.Array) -> pa.Array:
    """The letters in the given 1-based columns, in their order; columns outside the text have none, and null columns none at all."""
    texts = value.to_pylist()
    counts = columns.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat_columns = columns.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = ends_of(counts)

    def take(part: slice) -> list[str]:
        codes, starts = flat(texts[part])
        owner, _ = dealt(counts[part])
        column = flat_columns[first[part.start] : first[part.stop]]
        inside = (column >= 1) & (column <= np.diff(starts)[owner])
        chosen = codes[starts[owner[inside]] + column[inside] - 1]
        return unflat(chosen, ends_of(np.bincount(owner[inside], minlength=len(starts) - 1)))

    out: list[str] = []
    for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)) + counts):
        out += take(part)
    return pa.array(out, pa.string())


def kmer_codes(k: int):
    """UDF text -> a number for the window of ``k`` letters at each place, -1 where a letter is not A, C, G or T."""
    if not 1 <= k <= 31:
        raise ValueError("a window of 1 to 31 letters has a number")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def codes_of(value: pa.Array) -> pa.Array:
        texts = [x or "" for x in value.to_pylist()]
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
            letters, starts = flat(texts[part])
            kinds = LETTER_KIND[np.minimum(letters, 255)].astype(np.int64)
            n = np.maximum(np.diff(starts) - k + 1, 0)
            owner, nth = dealt(n)
            windows = max(len(kinds) - k + 1, 0)
            code = np.zeros(windows, np.int64)
            for j in range(k):
                code = code * 4 + (kinds[j : j + windows] & 3)
            bad = ends_of(kinds > 3)
            code[bad[k:] > bad[:windows]] = -1
            found.append(code[starts[owner] + nth])
            counts.append(n)
        return pa.ListArray.from_arrays(pa.array(ends_of(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(found)))

    return codes_of


@F.arrow_udf(T.IntegerType())
def unequal_columns(query: pa.Array, germline: pa.Array) -> pa.Array:
    """Unequal letters over the common length."""
    texts, others = query.to_pylist(), germline.to_pylist()

    found = [np.zeros(0, np.int64)]
    for part in pieces(np.fromiter((len(q) + len(g) for q, g in zip(texts, others, strict=True)), np.int64, len(texts))):
        (q, q0), (g, g0) = flat(texts[part]), flat(others[part])
        owner, nth = dealt(np.minimum(np.diff(q0), np.diff(g0)))
        found.append(np.bincount(owner[q[q0[owner] + nth] != g[g0[owner] + nth]], minlength=len(q0) - 1))
    return pa.array(np.concatenate(found), pa.int32())


def flat_column(value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, with no letters for a null. Plain ASCII is used where it lies, a byte for a letter."""
    value = value.cast(pa.large_string()).fill_null("")
    _, ends, data = value.buffers()
    starts = np.frombuffer(ends, np.int64)[value.offset : value.offset + len(value) + 1] if len(value) else np.zeros(1, np.int64)
    codes = np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]]
    if codes.size and codes.max() > 127:
        return flat(value.to_pylist())
    return codes, starts - starts[0]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def ungapped_positions(value: pa.Array) -> pa.Array:
    """The 1-based position of each letter without gaps, null for a gap; none for a null text."""
    codes, starts = flat_column(value)
    kept = codes != GAP
    steps = kept.astype(np.int32)
    first = starts[:-1][np.diff(starts) > 0]  # what a text has counted is taken off where the next one begins
    if len(first):
        steps[first[1:]] -= np.add.reduceat(steps, first)[:-1]
    positions = pa.Array.from_buffers(pa.int32(), len(codes), [pa.py_buffer(np.packbits(kept, bitorder="little")), pa.py_buffer(np.cumsum(steps, dtype=np.int32))])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), positions)
