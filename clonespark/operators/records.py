"""The compact scientific projection of a rearrangement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import is_true_flag, multiplicity, normalize_aa, normalize_nt, number, text

STUDY = ("dataset_id", "sample_id", "subject_id", "cohort", "timepoint", "compartment")


def denoise_sequence() -> Column:
    """The V-to-J slice by 1-based coordinates, else the alignment, else the read."""
    raw = text("sequence")
    start, end = F.floor(number("v_sequence_start")), F.floor(number("j_sequence_end"))
    valid = (raw != "") & (start >= 1) & (end >= start) & (end <= F.length(raw))
    aligned = text("sequence_alignment")
    return F.when(valid, F.substring(raw, start.cast("int"), (end - start + 1).cast("int"))).otherwise(
        F.when(aligned != "", aligned).otherwise(raw)
    )


def records(table: DataFrame) -> DataFrame:
    """One row per rearrangement with normalised sequences; columns are pruned by use."""
    aligned = text("sequence_alignment")
    return table.select(
        "ordinal",
        text("sequence_id").alias("sequence_id"),
        *[text(c).alias(c) for c in STUDY],
        text("locus").alias("locus"),
        text("v_call").alias("v_call"),
        text("j_call").alias("j_call"),
        text("c_call").alias("c_call"),
        normalize_nt("cdr3").alias("cdr3_nt"),
        normalize_aa("cdr3_aa").alias("cdr3_aa"),
        is_true_flag("productive").alias("productive"),
        normalize_nt("sequence").alias("sequence_nt"),
        normalize_nt(F.when(aligned != "", aligned).otherwise(text("sequence"))).alias("trimmed_nt"),
        normalize_nt(denoise_sequence()).alias("denoise_nt"),
        multiplicity("duplicate_count").alias("weight"),
    )
