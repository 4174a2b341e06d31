"""Tools on alignment columns: reading frame, column subsets, and the rows an alignment still holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import translate_columns
from ..functions.letters import FRAME_COUNTS, frame_counts, taken
from ..functions.sequences import text

PRESETS = ("full", "variable", "cdrs")


def reading_frame(rows: DataFrame, group: list[str], aligned: str = "aligned", preferred: int = 0) -> DataFrame:
    """The codon phase of each alignment: ``group, frame, mixed_gap_codons, stop_codons, complete_gap_codons, ambiguous_codons``.

    Of the three phases the one with the fewest codons that mix bases and gaps, then fewest stops, most whole-gap
    codons, fewest ambiguous codons, then the preferred and the lowest one. Counts are sums over rows, so an
    alignment of any number of rows is combined before it is shuffled.
    """
    cleaned = F.translate(F.upper(text(aligned)), ".", "-")
    names = list(FRAME_COUNTS)
    counted = rows.select(*group, frame_counts(cleaned).alias("c")).groupBy(*group).agg(*[F.sum(f"c.{n}_{p}").alias(f"{n}_{p}") for p in range(3) for n in names])
    phases = [F.struct(F.lit(p).alias("frame"), *[F.col(f"{n}_{p}").alias(n) for n in names]) for p in range(3)]
    each = counted.select(*group, F.inline(F.array(*phases)))
    order = F.struct("mixed_gap_codons", "stop_codons", -F.col("complete_gap_codons"), "ambiguous_codons", (F.col("frame") != preferred).cast("int"), "frame")
    best = each.groupBy(*group).agg(F.min_by(F.struct("frame", *names), order).alias("b"))
    return best.select(*group, "b.*")


def translate_alignments(rows: DataFrame, frames: DataFrame, group: list[str], aligned: str = "aligned") -> DataFrame:
    """``rows`` with ``residues``: each alignment translated in the phase found for it."""
    return rows.join(frames.select(*group, "frame"), group).withColumn("residues", translate_columns(aligned, F.col("frame"))).drop("frame")


def parse_columns(selection: str, labels: list[str] | None = None, maximum: int = 0) -> list[int]:
    """1-based columns named by numbers, ranges and labels such as ``31``, ``31A`` or ``32-35B``; unknown ones are left out.

    A label comes before a number of the same spelling. Ranges may run backwards.
    """
    index = {label.upper(): i for i, label in reversed(list(enumerate(labels or [], 1)))}

    def place(token: str) -> int | None:
        token = token.strip().upper()
        if token in index:
            return index[token]
        return int(token) if token.isdigit() and token.isascii() and 1 <= int(token) <= maximum else None

    chosen: set[int] = set()
    for token in filter(None, re.split(r"[\s,;]+", selection)):
        ends = re.fullmatch(r"([0-9]+[A-Za-z]?)-([0-9]+[A-Za-z]?)", token)
        if ends:
            a, b = place(ends[1]), place(ends[2])
            if a is not None and b is not None:
                chosen.update(range(min(a, b), max(a, b) + 1))
        elif (one := place(token)) is not None:
            chosen.add(one)
    return sorted(chosen)


def preset_columns(labels: DataFrame, preset: str, group: list[str]) -> DataFrame:
    """``group, column`` of a region preset, from one label per column (``group, column, region``, null where none wins).

    ``full`` takes all columns, ``variable`` those with a label, ``cdrs`` those of the CDRs, and any other name the
    columns of that region; ``custom`` takes none.
    """
    if preset == "custom":
        chosen = labels.filter(F.lit(False))
    elif preset == "full":
        chosen = labels
    elif preset == "variable":
        chosen = labels.filter("region IS NOT NULL")
    elif preset == "cdrs":
        chosen = labels.filter(F.startswith(F.col("region"), F.lit("cdr")))
    else:
        chosen = labels.filter(F.col("region") == preset)
    return chosen.select(*group, "column")


def take_columns(rows: DataFrame, columns: DataFrame | list[int], group: list[str], aligned: str = "aligned") -> DataFrame:
    """``rows`` with only the given columns of their alignment.

    ``columns`` is a list for all rows, or ``group, column`` rows: then one array per alignment, as long as it is wide,
    is joined to its rows. Rows of alignments without a chosen column become empty.
    """
    def picked(columns: Column) -> Column:
        return taken(text(aligned), columns)

    if isinstance(columns, list):
        return rows.withColumn(aligned, picked(F.array(*map(F.lit, columns)).cast("array<int>")) if columns else F.lit(""))
    chosen = columns.groupBy(*group).agg(F.array_sort(F.collect_set("column")).alias("chosen columns"))
    return rows.join(chosen, group, "left").withColumn(aligned, F.coalesce(picked(F.col("chosen columns")), F.lit(""))).drop("chosen columns")


def aligned_ordinal(name: Column | str) -> Column:
    """Ordinal in the name of an alignment row (``…__12`` is the record with ordinal 11), null without one."""
    digits = F.regexp_extract(text(name), r"__(\d+)$", 1)
    return F.when(digits != "", digits.try_cast("bigint") - 1)


def retained_rows(alignment: DataFrame, rows: DataFrame, name: str = "name") -> DataFrame:
    """The records that are still in an alignment; edited or added rows without an ordinal keep none."""
    kept = alignment.select(aligned_ordinal(name).alias("ordinal")).filter("ordinal IS NOT NULL").distinct()
    return rows.join(kept, "ordinal", "left_semi")
