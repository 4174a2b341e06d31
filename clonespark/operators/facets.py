"""Dashboards: facet counts and gene usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import calls, gene_of, is_true_flag, number, text, top_call
from .sampling import first_per_group

FACETS = (
    "dataset_id", "sample_id", "subject_id", "cohort", "timepoint", "compartment", "locus", "productive",
    "v_call", "d_call", "j_call", "c_call", "isotype",
)


def facet_counts(table: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """``(facet, value, records)`` over many columns in one pass; empty values are skipped."""
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), text(f).alias("value")) for f in facets])
    exploded = table.select(F.explode(entries).alias("e")).select("e.facet", "e.value").filter("value <> ''")
    return exploded.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("records"))


def ordered_facets(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Facet values with their ``rank`` within the facet: most records first, then by value; the first ``limit`` if one is given."""
    order = [F.desc("records"), F.col("value")]
    if limit is None:
        return counts.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(*order)))
    return first_per_group(counts, ["facet"], order, limit, "value").withColumnRenamed("nth", "rank")


def facet_grouping_sets(table: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by each of two columns and by both (grouping sets)."""
    view = table.select(text(first).alias(first), text(second).alias(second))
    return view.groupingSets([[first], [second], [first, second]], first, second).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("records")
    )


def call_facet(table: DataFrame, column: str) -> DataFrame:
    """Allele and gene tokens of a call column, each counted once per record."""
    upper = F.transform(calls(column), lambda c: F.upper(c))
    tokens = F.array_distinct(F.flatten(F.transform(upper, lambda c: F.array(c, gene_of(c)))))
    return table.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("records"))


def buckets(table: DataFrame, *columns: Column | str) -> DataFrame:
    """Repeat each record for the dashboard buckets it counts in.

    {all, productive} × {every locus, its own}; an empty locus counts only under ``*``.
    """
    locus = text("locus")
    kinds = F.when(is_true_flag("productive"), F.array(F.lit("all"), F.lit("productive"))).otherwise(F.array(F.lit("all")))
    loci = F.when(locus != "", F.array(F.lit("*"), locus)).otherwise(F.array(F.lit("*")))
    pairs = F.flatten(F.transform(kinds, lambda k: F.transform(loci, lambda p: F.struct(k.alias("status"), p.alias("locus")))))
    return table.select(F.explode(pairs).alias("bucket"), *columns).select("bucket.status", F.col("bucket.locus").alias("locus_bucket"), "*").drop("bucket")


def gene_usage(table: DataFrame, segment: str = "v", mode: str = "fractional") -> DataFrame:
    """Calls per bucket: the first call counts one, or every call counts ``1/n``."""
    column = f"{segment}_call"
    if mode == "top":
        rows = buckets(table, top_call(column).alias("call")).filter("call <> ''")
        return rows.groupBy("status", "locus_bucket", "call").agg(F.count(F.lit(1)).cast("double").alias("records"))
    listed = buckets(table, calls(column).alias("all_calls"))
    rows = listed.select("status", "locus_bucket", (1 / F.size("all_calls")).alias("share"), F.explode("all_calls").alias("call"))
    return rows.groupBy("status", "locus_bucket", "call").agg(F.sum("share").alias("records"))


def vj_pairs(table: DataFrame, mode: str = "fractional") -> DataFrame:
    """V–J pairings per bucket, by first calls or spread over every combination."""
    if mode == "top":
        rows = buckets(table, top_call("v_call").alias("v"), top_call("j_call").alias("j")).filter("v <> '' AND j <> ''")
        return rows.groupBy("status", "locus_bucket", "v", "j").agg(F.count(F.lit(1)).cast("double").alias("records"))
    # arrays are columns before the nested transform: lambda variables stay apart
    listed = buckets(table, calls("v_call").alias("vs"), calls("j_call").alias("js"))
    pairs = F.flatten(F.transform("vs", lambda v: F.transform("js", lambda j: F.struct(v.alias("v"), j.alias("j")))))
    listed = listed.select("status", "locus_bucket", pairs.alias("pairs")).filter(F.size("pairs") > 0)
    rows = listed.select("status", "locus_bucket", (1 / F.size("pairs")).alias("share"), F.explode("pairs").alias("p")).select("status", "locus_bucket", "share", "p.v", "p.j")
    return rows.groupBy("status", "locus_bucket", "v", "j").agg(F.sum("share").alias("records"))


def cdr3_lengths(table: DataFrame) -> DataFrame:
    """CDR3 amino-acid lengths per bucket; records without a CDR3 are skipped."""
    rows = buckets(table, F.length(text("cdr3_aa")).alias("length")).filter("length > 0")
    return rows.groupBy("status", "locus_bucket", "length").agg(F.count(F.lit(1)).alias("records"))


def identity_bins(table: DataFrame, column: str = "v_identity") -> DataFrame:
    """Records per rounded identity percent, halves rounding up."""
    rows = buckets(table, F.floor(number(column) * 100 + 0.5).cast("int").alias("percent")).filter("percent IS NOT NULL")
    return rows.groupBy("status", "locus_bucket", "percent").agg(F.count(F.lit(1)).alias("records"))


def isotype_usage(table: DataFrame) -> DataFrame:
    rows = buckets(table, text("isotype").alias("isotype")).filter("isotype <> ''")
    return rows.groupBy("status", "locus_bucket", "isotype").agg(F.count(F.lit(1)).alias("records"))


def as_percent(usage: DataFrame, keys: list[str], value: str = "records") -> DataFrame:
    """Share of the total within ``keys``, joined from an aggregate instead of a window.

    The aggregate combines map-side; a window would gather each bucket in one task.
    """
    totals = usage.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return usage.join(totals, keys).withColumn("percent", 100 * F.col(value) / F.col("_total")).drop("_total")


def gene_rollup(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Allele usage added up to genes."""
    return usage.groupBy(*keys, gene_of("call").alias("gene")).agg(F.sum("records").alias("records"))


def pairing_matrix(pairs: DataFrame, size: int = 12) -> DataFrame:
    """The pairings among the ``size`` most used V and J genes."""

    def leading(column: str) -> DataFrame:
        totals = pairs.groupBy(column).agg(F.sum("records").alias("_t"))
        return totals.orderBy(F.desc("_t"), column).limit(size).select(column)

    return pairs.join(leading("v"), "v", "left_semi").join(leading("j"), "j", "left_semi")


def summary_counts(table: DataFrame) -> DataFrame:
    """Assigned, productive and CDR3-bearing records as one row."""
    return table.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((text("v_call") != "") & (text("j_call") != "")).alias("assigned"),
        F.count_if(is_true_flag("productive")).alias("productive"),
        F.count_if(text("cdr3") != "").alias("with_cdr3"),
    )


def content_fingerprint(table: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count, XOR and wrapped sum of row hashes."""
    h = F.xxhash64(*[text(c) for c in sorted(table.columns)])
    return table.agg(
        F.count(F.lit(1)).alias("records"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash")
    )
