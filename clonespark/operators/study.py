"""Study metadata: scopes, dataset annotation and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import text

SCOPES = ("dataset", "sample", "subject", "cohort", "global")
METADATA_COLUMNS = ("sample_id", "subject_id", "cohort", "timepoint", "compartment")

# Most specific to broadest; a missing value falls back towards the dataset.
_CHAINS = {
    "dataset": ("dataset_id",),
    "sample": ("sample_id", "dataset_id"),
    "subject": ("subject_id", "sample_id", "dataset_id"),
    "cohort": ("cohort", "subject_id", "sample_id", "dataset_id"),
}


def scope_value(scope: str, alias: str = "") -> Column:
    """The study unit a record belongs to at this scope."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    if scope == "global":
        return F.lit("complete study")
    prefix = f"{alias}." if alias else ""
    return F.coalesce(*[F.nullif(text(prefix + c), F.lit("")) for c in _CHAINS[scope]], F.lit("legacy"))


def scope_key(scope: str) -> Column:
    return F.concat_ws(":", F.lit(scope), scope_value(scope))


def annotate_datasets(records: DataFrame, manifest: DataFrame, metadata: tuple[str, ...] = METADATA_COLUMNS) -> DataFrame:
    """Attach the study columns of each record's dataset and make ids collision-safe.

    ``manifest`` has one row per ``dataset_id``. Its size decides the join strategy.
    """
    keep = [c for c in records.columns if c not in metadata]
    original = text("sequence_id")
    joined = records.select(*keep).join(manifest.select("dataset_id", *metadata), "dataset_id", "left")
    named = F.concat_ws("::", "dataset_id", F.when(original == "", "record").otherwise(original))
    return joined.select(
        *[c for c in keep if c != "sequence_id"],
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in metadata],
        named.alias("sequence_id"),
        original.alias("source_sequence_id"),
    )


def overlay_metadata(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace study columns for the datasets named in ``overrides``; others keep theirs."""
    renamed = overrides.select(
        "dataset_id", F.lit(True).alias("_hit"), *[F.trim(text(c)).alias(f"_{c}") for c in METADATA_COLUMNS]
    )
    joined = records.join(renamed, "dataset_id", "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in METADATA_COLUMNS else F.col(c)
            for c in records.columns
        ]
    )
