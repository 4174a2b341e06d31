"""Exact collapse: records with one key become one representative with a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import call_set
from .study import scope_key

KEYS = ("sequence", "trimmed", "cdr3", "rearrangement")
UNASSIGNED_C = "__C_UNASSIGNED__"


def constant_partition(respect: bool) -> Column:
    """Top C gene, so isotypes stay apart; an absent call is its own partition."""
    if not respect:
        return F.lit("")
    return F.coalesce(F.get(call_set("c_call", "gene", "top"), F.lit(0)), F.lit(UNASSIGNED_C))


def _key_columns(key: str) -> tuple[list[Column], Column]:
    """Key columns and whether a record has a usable key.

    Full reads shuffle as a 256-bit digest, a tenth of their length.
    """
    if key in ("sequence", "trimmed"):
        column = F.col(f"{key}_nt")
        return [F.unhex(F.sha2(column, 256)).alias("k0")], column != ""
    if key == "cdr3":
        return [F.col("locus").alias("k0"), F.col("cdr3_nt").alias("k1")], (F.col("locus") != "") & (F.col("cdr3_nt") != "")
    if key == "rearrangement":
        parts = ["locus", "v_call", "j_call", "cdr3_nt"]
        usable = F.lit(True)
        for part in parts:
            usable = usable & (F.col(part) != "")
        return [F.col(p).alias(f"k{i}") for i, p in enumerate(parts)], usable
    raise ValueError(f"key must be one of {KEYS}")


def _keyed(records: DataFrame, key: str, scope: str, respect_constant: bool) -> tuple[DataFrame, list[str]]:
    columns, usable = _key_columns(key)
    keyed = records.select(
        "ordinal", "weight", usable.alias("usable"), scope_key(scope).alias("scope"),
        constant_partition(respect_constant).alias("c_part"), *columns,
    )
    return keyed, ["scope", "c_part", *[f"k{i}" for i in range(len(columns))]]


def collapse(
    records: DataFrame, key: str = "trimmed", scope: str = "sample", unresolved: str = "discard", respect_constant: bool = True
) -> DataFrame:
    """``(representative, count, members)``: one row per retained representative.

    The representative is the earliest record. Both aggregates combine map-side, so
    one key holding a third of all rows still shuffles one row per task.
    """
    keyed, names = _keyed(records, key, scope, respect_constant)
    groups = keyed.filter("usable").groupBy(*names).agg(
        F.min("ordinal").alias("representative"), F.sum("weight").alias("count"), F.count(F.lit(1)).alias("members")
    )
    groups = groups.select("representative", "count", "members")
    if unresolved == "retain":
        kept = keyed.filter(~F.col("usable")).select(
            F.col("ordinal").alias("representative"), F.col("weight").alias("count"), F.lit(1).cast("bigint").alias("members")
        )
        groups = groups.unionByName(kept)
    elif unresolved != "discard":
        raise ValueError("unresolved must be 'discard' or 'retain'")
    return groups


def collapse_members(
    records: DataFrame, key: str = "trimmed", scope: str = "sample", unresolved: str = "discard", respect_constant: bool = True
) -> DataFrame:
    """``(ordinal, representative)``; discarded records have a NULL representative."""
    keyed, names = _keyed(records, key, scope, respect_constant)
    usable = keyed.filter("usable")
    first = usable.groupBy(*names).agg(F.min("ordinal").alias("representative"))
    # null-safe keys are not needed: every key column is text that is never NULL
    found = usable.join(first, names).select("ordinal", "representative")
    kept = F.col("ordinal") if unresolved == "retain" else F.lit(None).cast("bigint")
    rest = keyed.filter(~F.col("usable")).select("ordinal", kept.alias("representative"))
    return found.unionByName(rest)


def largest_groups(groups: DataFrame, limit: int = 100) -> DataFrame:
    """The biggest groups with more than one copy (top-k)."""
    return groups.filter("count > 1").orderBy(F.desc("count"), "representative").limit(limit)


def collapse_summary(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Input records and abundance against what the collapse kept, as one row."""
    before = records.agg(F.count(F.lit(1)).alias("input_records"), F.sum("weight").alias("input_abundance"))
    after = groups.agg(F.count(F.lit(1)).alias("unique_records"), F.sum("count").alias("retained_abundance"))
    # both sides are single aggregate rows
    return before.withColumn("one", F.lit(1)).join(after.withColumn("one", F.lit(1)), "one").select(
        "input_records", "input_abundance", "unique_records", "retained_abundance",
        (F.col("input_records") - F.col("unique_records")).alias("collapsed_records"),
    )


def apply_collapse(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The representatives with ``weight`` replaced by the collapsed count."""
    counts = groups.select(F.col("representative").alias("ordinal"), F.col("count").alias("weight"))
    return records.drop("weight").join(counts, "ordinal")
