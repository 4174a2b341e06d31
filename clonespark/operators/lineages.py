"""Clonal lineages: single-linkage clustering of CDR3s within compatible V/J calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import call_set, distance_limit, text
from ..session import cut
from .components import connected_components
from .simjoin import HOT_GROUP, hamming_pairs
from .study import scope_key, scope_value


@dataclass(frozen=True)
class LineageOptions:
    identity: float = 0.85
    resolution: str = "gene"
    ambiguity: str = "overlap"
    productive_only: bool = True
    same_locus: bool = True
    scope: str = "subject"
    hot_group: int = HOT_GROUP


def pair_tokens(v: Column, j: Column, ambiguity: str) -> Column:
    """Join keys of a record: one per (V, J) pair, or the whole sets when strict."""
    if ambiguity == "strict":
        whole = F.concat_ws("/", F.concat_ws("+", v), F.concat_ws("+", j))
        return F.when((F.size(v) > 0) & (F.size(j) > 0), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(v, lambda a: F.transform(j, lambda b: F.concat_ws("/", a, b))))


def eligible(records: DataFrame, options: LineageOptions) -> DataFrame:
    """Records that can enter a lineage, with their join keys."""
    v = call_set("v_call", options.resolution, options.ambiguity)
    j = call_set("j_call", options.resolution, options.ambiguity)
    keyed = records.select(
        "*",
        pair_tokens(v, j, options.ambiguity).alias("tokens"),
        scope_key(options.scope).alias("scope"),
        (text("locus") if options.same_locus else F.lit("*")).alias("hard_locus"),
    )
    usable = (F.col("cdr3_nt") != "") & (F.size("tokens") > 0)
    return keyed.filter(usable & F.col("productive") if options.productive_only else usable)


def assign_lineages(records: DataFrame, options: LineageOptions | None = None) -> DataFrame:
    """``(ordinal, lineage_id)`` for every record that can be assigned.

    ``records`` are the active representatives (see ``operators.records``).
    ``lineage_id`` is the smallest ordinal of the lineage: it does not depend on
    partitioning or order. Records with equal scope, calls and CDR3 are one node of
    the similarity graph, so abundance never inflates the join.
    """
    options = options or LineageOptions()
    members = eligible(records, options).select("ordinal", "scope", "hard_locus", "tokens", "cdr3_nt")
    key = ["scope", "hard_locus", "tokens", "cdr3_nt"]
    nodes = cut(members.groupBy(*key).agg(F.min("ordinal").alias("id")))
    # NUL-free separator: calls and scope values are cell text and hold no tab.
    probe = nodes.withColumn("token", F.explode("tokens")).select(
        "id",
        F.concat_ws("\t", "scope", "hard_locus", "token").alias("part"),
        F.col("cdr3_nt").alias("seq"),
        distance_limit(options.identity, F.length("cdr3_nt")).alias("lim"),
    )
    edges = hamming_pairs(probe, hot_group=options.hot_group, links_only=True)
    components = connected_components(nodes, edges)
    labelled = nodes.join(components, "id").select(*key, F.col("component").alias("lineage_id"))
    return members.join(labelled, key).select("ordinal", "lineage_id")


def inherit_assignments(assignments: DataFrame, representatives: DataFrame) -> DataFrame:
    """Give every collapsed member the lineage of its representative.

    ``representatives`` is ``(ordinal, representative)``; records without one, or
    whose representative is unassigned, get no row.
    """
    owner = assignments.select(F.col("ordinal").alias("representative"), "lineage_id")
    return representatives.join(owner, "representative").select("ordinal", "representative", "lineage_id")


def lineage_summary(records: DataFrame, assignments: DataFrame, options: LineageOptions | None = None) -> DataFrame:
    """One row per lineage. ``records.weight`` is the collapsed abundance."""
    options = options or LineageOptions()
    joined = records.join(assignments, "ordinal")
    first = F.struct(
        "ordinal", "locus", "v_call", "j_call", "cdr3_nt", "cdr3_aa", scope_value(options.scope).alias("study_group")
    )
    grouped = joined.groupBy("lineage_id").agg(
        F.count(F.lit(1)).alias("unique_members"), F.sum("weight").alias("abundance"), F.min(first).alias("rep")
    )
    return grouped.select(
        "lineage_id",
        F.col("rep.ordinal").alias("representative_ordinal"),
        "unique_members",
        "abundance",
        F.col("rep.locus").alias("locus"),
        call_set("rep.v_call", options.resolution, options.ambiguity).alias("v_calls"),
        call_set("rep.j_call", options.resolution, options.ambiguity).alias("j_calls"),
        F.length("rep.cdr3_nt").alias("cdr3_length"),
        F.col("rep.cdr3_nt").alias("representative_cdr3_nt"),
        F.col("rep.cdr3_aa").alias("representative_cdr3_aa"),
        F.col("rep.study_group").alias("study_group"),
    )


def top_lineages(summary: DataFrame, limit: int = 10_000) -> DataFrame:
    """The browsing table: largest lineages first (a top-k, never a full sort)."""
    return summary.orderBy(F.desc("abundance"), F.desc("unique_members"), "lineage_id").limit(limit)


# The size classes of the lineage histogram.
SIZE_CLASSES = (
    (1, "1"), (3, "2–3"), (9, "4–9"), (24, "10–24"), (99, "25–99"), (499, "100–499"), (None, "500+"),
)


def size_histogram(summary: DataFrame) -> DataFrame:
    """Number of lineages per abundance class."""
    label: Column | None = None
    for upper, name in SIZE_CLASSES:
        if upper is None:
            label = label.otherwise(name)
        else:
            hit = F.col("abundance") <= upper
            label = F.when(hit, name) if label is None else label.when(hit, name)
    return summary.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("lineages"))


def call_usage(summary: DataFrame, column: str) -> DataFrame:
    """Lineages and abundance per representative call (``v_calls`` or ``j_calls``)."""
    return summary.select(F.explode(column).alias("call"), "abundance").groupBy("call").agg(
        F.count(F.lit(1)).alias("lineages"), F.sum("abundance").alias("abundance")
    )


def sample_counts(source: DataFrame, members: DataFrame) -> DataFrame:
    """Per lineage and sample: unique representatives and source-read abundance.

    ``source`` are the uncollapsed records, ``members`` their
    ``(ordinal, representative, lineage_id)``. Distinct representatives are reduced
    first so that no group is held whole.
    """
    rows = source.select("ordinal", "sample_id", "weight").join(members, "ordinal").filter(F.col("sample_id") != "")
    per_representative = rows.groupBy("lineage_id", "sample_id", "representative").agg(F.sum("weight").alias("abundance"))
    return per_representative.groupBy("lineage_id", "sample_id").agg(
        F.count(F.lit(1)).alias("unique_members"), F.sum("abundance").alias("abundance")
    )


def study_values(source: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct non-empty samples, subjects, timepoints and compartments per lineage, in long form."""
    fields = ("sample_id", "subject_id", "timepoint", "compartment")
    rows = source.select("ordinal", *fields).join(members.select("ordinal", "lineage_id"), "ordinal")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return rows.select("lineage_id", pairs.alias("p")).select("lineage_id", "p.*").filter("value <> ''").distinct()


def double_d_counts(records: DataFrame, assignments: DataFrame, positives: DataFrame) -> DataFrame:
    """Members and abundance of each lineage with evidence for two D segments."""
    flagged = records.join(assignments, "ordinal").join(
        positives.select("ordinal").distinct().withColumn("positive", F.lit(1)), "ordinal", "left"
    )
    return flagged.groupBy("lineage_id").agg(
        F.count(F.lit(1)).alias("unique_members"),
        F.count("positive").alias("positive_members"),
        F.coalesce(F.sum(F.when(F.col("positive") == 1, F.col("weight"))), F.lit(0)).alias("positive_abundance"),
    )


def double_d_matches(mode: str) -> Column:
    """Lineage filter on the columns of ``double_d_counts``."""
    positive, members = F.col("positive_members"), F.col("unique_members")
    return {
        "any": F.lit(True),
        "present": positive > 0,
        "all": (positive > 0) & (positive == members),
        "absent": positive == 0,
    }[mode]


def merge_lineages(assignments: DataFrame, merges: DataFrame) -> DataFrame:
    """Union chosen lineages; merges that touch are closed transitively.

    ``merges(left_id, right_id)`` names lineage ids. Adds ``merged_lineage_id``.
    """
    vertices = assignments.select(F.col("lineage_id").alias("id")).distinct()
    closed = connected_components(vertices, merges).select(
        F.col("id").alias("lineage_id"), F.col("component").alias("merged_lineage_id")
    )
    return assignments.join(closed, "lineage_id")


def explore(
    summary: DataFrame,
    samples: DataFrame,
    *,
    search: str = "",
    locus: str = "",
    min_abundance: int = 0,
    min_unique: int = 0,
    min_samples: int = 0,
    cdr3_length: tuple[int, int] = (0, 0),
    sample_mode: str = "any",
    selected: tuple[str, ...] = (),
) -> DataFrame:
    """Lineage browser filter.

    ``samples`` is the output of ``sample_counts``. Sample modes: ``any``,
    ``multiple``, ``single``, ``selected-any``, ``selected-all``, ``selected-only``.
    Membership is reduced to counts per lineage before it meets the summary.
    """
    chosen = F.col("sample_id").isin(*selected) if selected else F.lit(False)
    per_lineage = samples.groupBy("lineage_id").agg(
        F.count(F.lit(1)).alias("sample_total"), F.count_if(chosen).alias("chosen_total")
    )
    rows = summary.join(per_lineage, "lineage_id", "left").fillna(0, ["sample_total", "chosen_total"])
    total, hits = F.col("sample_total"), F.col("chosen_total")
    modes = {
        "any": F.lit(True),
        "multiple": total > 1,
        "single": total == 1,
        "selected-any": hits > 0,
        "selected-all": hits == len(set(selected)),
        "selected-only": (hits > 0) & (hits == total),
    }
    keep = modes[sample_mode] & (F.col("abundance") >= min_abundance) & (F.col("unique_members") >= min_unique)
    keep = keep & (total >= min_samples)
    if locus:
        keep = keep & (F.col("locus") == locus)
    if cdr3_length[0]:
        keep = keep & (F.col("cdr3_length") >= cdr3_length[0])
    if cdr3_length[1]:
        keep = keep & (F.col("cdr3_length") <= cdr3_length[1])
    if search:
        haystack = F.upper(
            F.concat_ws(" ", F.col("lineage_id").cast("string"), F.array_join("v_calls", ","), F.array_join("j_calls", ","),
                        "representative_cdr3_nt", "representative_cdr3_aa", "study_group")
        )
        keep = keep & haystack.contains(search.upper())
    return rows.filter(keep)
