"""Germline reference sets as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import infer_locus, normalize_nt, text

# The integers of an annotated germline header, in order.
METADATA_FIELDS = (
    "frame", "cdr3_stop", "fwr1_start", "fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end",
    "cdr2_start", "cdr2_end", "fwr3_start", "fwr3_end", "source",
)


def parse_germline(fasta: DataFrame, tag: str = r"[A-Z]+META") -> DataFrame:
    """Annotated germlines from FASTA rows ``(id, description, sequence)``.

    The description may carry ``<TAG>=`` and thirteen comma-separated integers. A tag
    with another number of values is an error, a missing one leaves them NULL.
    """
    header = F.concat_ws(" ", "id", text("description"))
    listed = F.regexp_extract(header, rf"(?:^|\s){tag}=([-\d,]+)", 1)
    rows = fasta.select(F.col("id").alias("name"), infer_locus("id").alias("locus"), normalize_nt("sequence").alias("sequence"), listed.alias("_m"))
    values = F.split("_m", ",")
    checked = F.when(F.col("_m") == "", None).otherwise(
        F.when(F.size(values) == len(METADATA_FIELDS), values).otherwise(
            F.raise_error(F.concat(F.lit("Malformed germline metadata for "), F.col("name"))).cast("array<string>")
        )
    )
    return rows.withColumn("_v", checked).select(
        "name", "locus", "sequence", *[F.try_element_at("_v", F.lit(i + 1)).cast("int").alias(f) for i, f in enumerate(METADATA_FIELDS)]
    )


def exclude_alleles(reference: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference without the named alleles, and the names that matched nothing."""
    names = excluded.select("name").distinct()
    return reference.join(names, "name", "left_anti"), names.join(reference.select("name"), "name", "left_anti")


def compose_reference(baseline: DataFrame, overrides: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Replace whole (locus, segment) cells of the baseline by the override rows."""
    cells = overrides.select("locus", "segment").distinct()
    kept = baseline.join(cells, ["locus", "segment"], "left_anti")
    out = kept.unionByName(overrides, allowMissingColumns=True)
    return out if exclusions is None else out.join(exclusions.select("locus", "segment", "name"), ["locus", "segment", "name"], "left_anti")


def template_tiers(pack: DataFrame, species: str, taxon: str, genus: str) -> DataFrame:
    """Annotated templates by closeness: own species, taxon, genus, anything.

    ``pack`` has ``species, taxon, genus, name, sequence``. An allele is kept once, in
    its closest tier.
    """
    tier = F.when(F.col("species") == species, 0).when(F.col("taxon") == taxon, 1).when(F.col("genus") == genus, 2).otherwise(3)
    return pack.withColumn("tier", tier).groupBy("name", "sequence").agg(F.min_by(F.struct("tier", "species"), F.struct("tier", "species")).alias("t")).select(
        "name", "sequence", "t.tier", "t.species"
    )


def load_pack(pack: DataFrame) -> DataFrame:
    """Flatten a nested pack ``species -> locus -> segment -> alleles`` to rows."""
    loci = pack.select("species", F.explode("loci").alias("locus", "segments"))
    segments = loci.select("species", "locus", F.explode("segments").alias("segment", "alleles"))
    return segments.select("species", "locus", "segment", F.explode("alleles").alias("a")).select("species", "locus", "segment", "a.*")


# Loci of each receptor scope.
SCOPES = {
    "BCR": ("IGH", "IGK", "IGL"),
    "TCR": ("TRA", "TRB", "TRD", "TRG"),
    "ALL": ("IGH", "IGK", "IGL", "TRA", "TRB", "TRD", "TRG"),
}


def alleles_for_scope(reference: DataFrame, scope: str, segment: str | None = None) -> DataFrame:
    loci = SCOPES.get(scope, (scope,))
    rows = reference.filter(F.col("locus").isin(*loci))
    return rows if segment is None else rows.filter(F.col("segment") == segment)


def annotation_coverage(reference: DataFrame) -> DataFrame:
    """Alleles and annotated alleles per locus and segment."""
    return reference.groupBy("locus", "segment").agg(
        F.count(F.lit(1)).alias("alleles"), F.count_if(F.coalesce(F.col("frame"), F.lit(0)) > 0).alias("annotated")
    )


def apply_internal_data(reference: DataFrame, internal: DataFrame) -> DataFrame:
    """Exact-name V annotation join; the supplied frame and regions replace the own ones."""
    fields = [c for c in METADATA_FIELDS if c in internal.columns]
    new = internal.select("name", *[F.col(c).alias(f"_{c}") for c in fields])
    joined = reference.join(new, "name", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in reference.columns])


def nearest_templates(targets: DataFrame, templates: DataFrame, k: int = 9, keep: int | None = None) -> DataFrame:
    """Nearest annotated templates by Jaccard similarity of distinct k-mers.

    k-mers are joined within a locus and counted; only pairs sharing one exist. ``keep``
    cuts the ranking to so many templates a target.
    """

    def kmers(side: DataFrame, name: str) -> DataFrame:
        last = F.length("sequence") - k + 1
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col("sequence"), i, F.lit(k))))
        return side.filter(last >= 1).select("locus", F.col("name").alias(name), F.size(grams).alias(f"{name}_size"), F.explode(grams).alias("gram"))

    shared = kmers(targets, "target").join(kmers(templates, "template"), ["locus", "gram"]).groupBy("target", "template", "target_size", "template_size").agg(
        F.count(F.lit(1)).alias("shared")
    )
    scored = shared.withColumn("jaccard", F.col("shared") / (F.col("target_size") + F.col("template_size") - F.col("shared")))
    # a target meets at most the alleles of its locus
    best = scored.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("x"), F.col("template")))).alias("b")
    )
    if keep is not None:
        best = best.withColumn("b", F.slice("b", 1, keep))
    return best.select("target", F.posexplode("b").alias("rank", "e")).select("target", "rank", F.col("e.template").alias("template"), (-F.col("e.x")).alias("jaccard"))


def donors_from_paths(paths: Column) -> Column:
    """Donor inferred from the directory that holds a file; empty at the top level."""
    parts = F.split(paths, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
