"""Gapped columns and ungapped positions of aligned sequences, as native expressions.

Two arrays per row answer everything: ``residue_columns`` (select: the column of each residue) and
``residue_ranks`` (rank: residues up to each column). Both are linear in the width of the
alignment, except that Spark builds arrays by ``transform`` over a bounded row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .letters import COLUMN_RESIDUE, motif_cover, projected, translation
from .sequences import codon_map, col, text

#: Nucleotides that an IUPAC code of a motif stands for; other letters stand for themselves.
MOTIF_CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT", ".": "ACGT",
}
_LITERAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ*.")
#: Any letter at a place of a motif.
ANY = "any"


def _characters(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.split(value, "")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def residue_columns(aligned: Column | str) -> Column:
    """1-based column of each residue (select)."""
    placed = F.transform(_characters(text(aligned)), lambda c, i: F.when(c != "-", i + 1))
    return F.filter(placed, lambda i: i.isNotNull())


def residue_ranks(aligned: Column | str) -> Column:
    """Number of residues up to and with each column (rank).

    Runs between gaps are walked, not columns: a run of ``n`` residues behind ``r`` earlier ones gives ``r + 1 .. r + n``, the
    gap behind it repeats ``r + n``.
    """
    runs = F.split(text(aligned), "-", -1)
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<struct<at:int,n:int>>").alias("parts"))
    walked = F.aggregate(
        runs, start,
        lambda s, run: F.struct((s["seen"] + F.length(run)).alias("seen"), F.concat(s["parts"], F.array(F.struct(s["seen"].alias("at"), F.length(run).alias("n")))).alias("parts")),
    )["parts"]
    flat = F.flatten(F.transform(walked, lambda p, i: F.concat(
        F.when(i > 0, F.array(p["at"])).otherwise(F.array().cast("array<int>")),
        F.when(p["n"] > 0, F.sequence(p["at"] + 1, p["at"] + p["n"])).otherwise(F.array().cast("array<int>")),
    )))
    return F.when(F.length(text(aligned)) > 0, flat).otherwise(F.array().cast("array<int>"))


def ungapped(value: Column | str) -> Column:
    """Upper case, U as T, without ``-``."""
    return F.translate(F.upper(text(value)), "U-", "T")


def _pad(value: Column) -> Column:
    """At least three characters, filled with ``-``; the empty text stays empty."""
    return F.when(F.length(value) == 0, "").when(F.length(value) < 3, F.rpad(value, 3, "-")).otherwise(value)


def _offset(frame: Column | int) -> Column:
    value = frame if isinstance(frame, Column) else F.lit(frame)
    return F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(value.cast("int"), F.lit(0))))


def project_codons(dna: Column | str, aligned_residues: Column | str, frame: Column | int = 0) -> Column:
    """The nucleotides behind an aligned protein: each of its gaps becomes ``---``.

    Bases before the frame and behind the last residue are kept, filled up to a codon. A residue for which bases are
    missing is filled up too.
    """
    return projected(ungapped(dna), _offset(frame), text(aligned_residues))


def _codons(value: Column, offset: Column, partial: bool) -> Column:
    def cut(s: Column) -> Column:
        n = (F.ceil(F.length(s) / 3) if partial else F.floor(F.length(s) / 3)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(s, k * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))

    return let(F.substring(value, offset + 1, F.length(value)), cut)


def _translated(codon: Column) -> Column:
    return F.coalesce(F.try_element_at(codon_map(), codon), F.lit("X"))


def translate_ungapped(value: Column | str, frame: Column | int = 0) -> Column:
    """Complete codons of the sequence without its gaps; anything that is no codon reads ``X``."""
    return translation(COLUMN_RESIDUE, False)(ungapped(value), _offset(frame))


def translate_segment(value: Column | str) -> Column:
    """Complete codons of an aligned segment; a codon with any gap reads ``-``."""
    return F.array_join(F.transform(_codons(F.upper(text(value)), F.lit(0), False), lambda c: F.when(F.contains(c, F.lit("-")), "-").otherwise(_translated(c))), "")


def translate_columns(value: Column | str, frame: Column | int = 0) -> Column:
    """One residue per column triple: ``---`` reads ``-``, a mixed, ambiguous or incomplete triple ``X``."""
    return translation(COLUMN_RESIDUE, True)(F.upper(text(value)), _offset(frame))


def frame_offset(query_start: Column | str, sequence_frame: Column | str) -> Column:
    """Bases between the start of a segment and its first whole codon; both coordinates count from one, 0 or null is unknown."""
    start, frame = F.coalesce(col(query_start).cast("int"), F.lit(0)), F.coalesce(col(sequence_frame).cast("int"), F.lit(0))
    return F.when((start == 0) | (frame == 0), 0).otherwise(F.pmod(frame - start, F.lit(3)))


def segment_residues(query: Column | str, reference: Column | str, query_start: Column | str, sequence_frame: Column | str) -> Column:
    """``struct<query, reference>`` of the residues of an aligned segment from its first whole codon on, or null."""
    skip = frame_offset(query_start, sequence_frame)
    first = F.when(skip == 0, 0).otherwise(F.coalesce(F.get(residue_columns(query), skip - 1), F.length(text(query))))

    def residues(at: Column) -> Column:
        return F.struct(*[translate_segment(F.substring(text(s), at + 1, F.length(text(s)))).alias(name) for name, s in (("query", query), ("reference", reference))])

    known = (text(query) != "") & (text(reference) != "") & (F.coalesce(col(query_start).cast("int"), F.lit(0)) != 0) & (F.coalesce(col(sequence_frame).cast("int"), F.lit(0)) != 0)
    return F.when(known, let(let(first, residues), lambda p: F.when((p["query"] != "") | (p["reference"] != ""), p)))


def motif_letters(motif: str, alphabet: str = "nt") -> list[str]:
    """The letters that fit each place of a motif. White space and gaps are left out; in proteins X and ``.`` are open."""
    letters = [c for c in motif.upper() if not c.isspace() and c != "-"]
    unknown = set(letters) - _LITERAL
    if unknown:
        raise ValueError(f"Motif {motif!r} holds {sorted(unknown)}.")
    if alphabet == "nt":
        return [MOTIF_CODES.get(c, c) for c in letters]
    return [ANY if c in "X." else c for c in letters]


def motif_cells(aligned: Column | str, motifs: list[str], alphabet: str = "nt") -> Column:
    """Number of the first motif that covers each column, 0 where none does.

    Motifs are sought in the sequence without gaps, overlapping matches included, and put back on its columns.
    """
    letters = [motif_letters(motif, alphabet) for motif in motifs]
    return motif_cover(letters, ANY)(F.upper(text(aligned)))


def normalized_masses(values: Column | str) -> Column:
    """Masses as probabilities. What is not a positive finite number counts as zero; without any mass all are equal.

    The rounding rest goes to the largest entry (the first of equal ones), or to the last one if all are equal.
    """
    safe = F.transform(col(values), lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")), v.cast("double")).otherwise(0.0))

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    def shared(v: Column) -> Column:
        return let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)).otherwise(F.transform(v, lambda x: F.lit(1.0) / F.size(v))))

    def repaired(v: Column) -> Column:
        largest = F.when(F.array_max(v) > F.array_min(v), F.array_position(v, F.array_max(v))).otherwise(F.size(v))
        parts = F.struct(largest.cast("int").alias("at"), (F.lit(1.0) - total(v)).alias("rest"))
        return let(parts, lambda p: F.transform(v, lambda x, i: F.when(i + 1 == p["at"], F.greatest(F.lit(0.0), x + p["rest"])).otherwise(x)))

    return F.when(F.size(safe) == 0, F.array().cast("array<double>")).otherwise(let(let(safe, shared), repaired))
