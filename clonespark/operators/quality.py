"""FASTQ quality filtering and seeded subsampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import three_prime_trim


@dataclass(frozen=True)
class QualityOptions:
    phred_offset: int = 33
    max_expected_errors: float = 1.0
    trim: bool = True
    window: int = 4
    min_mean_phred: float = 20.0
    min_length: int = 1

    def __post_init__(self) -> None:
        if self.max_expected_errors < 0:
            raise ValueError("max_expected_errors may not be below zero.")
        if self.phred_offset not in (33, 64):
            raise ValueError("The Phred offset is 33 or 64.")


def judged_reads(reads: DataFrame, options: QualityOptions) -> DataFrame:
    """Reads with ``trimmed_length``, ``expected_errors`` and an ``outcome``."""
    trim = three_prime_trim(options.phred_offset, options.window, options.min_mean_phred, options.trim)
    judged = reads.withColumn("_t", trim("quality")).select("*", "_t.trimmed_length", "_t.expected_errors").drop("_t")
    short = F.lit(options.trim) & (F.col("trimmed_length") < max(1, options.min_length))
    outcome = F.when(short, "too_short").when(F.col("expected_errors") > options.max_expected_errors, "too_many_errors").otherwise("retained")
    return judged.withColumn("outcome", outcome)


def filter_reads(reads: DataFrame, options: QualityOptions | None = None) -> DataFrame:
    """Retained reads, trimmed at the 3' end."""
    kept = judged_reads(reads, options or QualityOptions()).filter("outcome = 'retained'")
    return kept.withColumn("sequence", F.expr("substring(sequence, 1, trimmed_length)")).withColumn(
        "quality", F.expr("substring(quality, 1, trimmed_length)")
    )


def quality_statistics(judged: DataFrame) -> DataFrame:
    """Counters of a filter run; sums of per-file results add up to the whole."""
    retained = F.col("outcome") == "retained"
    removed = F.length("quality") - F.col("trimmed_length")
    return judged.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(retained).alias("retained"),
        F.count_if(F.col("outcome") == "too_short").alias("rejected_length"),
        F.count_if(F.col("outcome") == "too_many_errors").alias("rejected_errors"),
        F.count_if(retained & (removed > 0)).alias("trimmed_reads"),
        F.coalesce(F.sum(F.when(retained, removed)), F.lit(0)).alias("trimmed_bases"),
    )


def subsample(reads: DataFrame, size: int, seed: int = 1, key: str = "ordinal") -> DataFrame:
    """A fixed-size uniform sample, reproducible for a seed whatever the partitioning.

    The ``size`` smallest salted hashes form the sample: a top-k per task, then one
    merge. Rows come back in input order.
    """
    salted = reads.withColumn("_h", F.md5(F.concat_ws("\t", F.lit(str(seed)), F.col(key).cast("string"))))
    return salted.orderBy("_h", key).limit(size).drop("_h").orderBy(key)
