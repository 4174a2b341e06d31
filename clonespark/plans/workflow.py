"""The study workflow: the fixed chain of stages over one rearrangement table.

refinement → collapse → chimera → selection → lineages → hypermutation → missing alleles

A stage never edits rows. It narrows the working set, a DataFrame of ordinals, or adds a
keyed result; the table itself stays as read.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chimera import retained, score_chimeras
from ..operators.collapse import apply_collapse, collapse, collapse_members
from ..operators.denoise import denoise
from ..operators.lineages import assign_lineages, inherit_assignments, lineage_summary, sample_counts
from ..operators.missing import missing_alleles
from ..operators.records import records
from ..operators.refinement import apply_refinement, refine_calls
from ..operators.selection import select_repertoire
from ..operators.shm import shm_metrics, weighted_distribution
from ..session import cut
from .config import StudyConfig


@dataclass
class StudyResult:
    """Results by name; each is a DataFrame keyed by ordinal or lineage."""

    table: DataFrame
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {name: frame.count() for name, frame in self.frames.items()}


def run_study(
    table: DataFrame, config: StudyConfig | None = None, references: dict[str, DataFrame] | None = None, panel: DataFrame | None = None, evidence: DataFrame | None = None
) -> StudyResult:
    """Run every enabled stage.

    ``references`` maps a segment to ``(name, sequence)`` for refinement and allele
    screening; ``panel`` is the aligned reference of the chimera stage; ``evidence`` the
    sparse second-D table.
    """
    config, references = config or StudyConfig(), references or {}
    result = StudyResult(table)
    frames = result.frames
    if config.refinement.enabled:
        for segment in config.refinement.segments:
            options = dataclasses.replace(config.refinement.options, segment=segment)
            refined = cut(refine_calls(table, references[segment], options))
            frames[f"refined_{segment.lower()}"] = refined
            table = apply_refinement(table, refined, segment, config.refinement.policy, config.refinement.minimum_posterior)
    base = records(table)

    if config.collapse.enabled:
        c = config.collapse
        if c.mode == "exact":
            groups = cut(collapse(base, c.key, c.scope, c.unresolved, c.respect_constant))
            members = collapse_members(base, c.key, c.scope, c.unresolved, c.respect_constant)
        else:
            options = dataclasses.replace(c.denoise, mode=c.mode, scope=c.scope, unresolved=c.unresolved, respect_constant=c.respect_constant)
            groups, members = denoise(base, options)
            groups = cut(groups)
        active = apply_collapse(base, groups)
        frames["groups"] = groups
    else:
        active, members = base, base.select("ordinal", F.col("ordinal").alias("representative"))
    members = members.filter("representative IS NOT NULL")
    mask = active.select("ordinal")

    if config.chimera.enabled:
        scored = cut(score_chimeras(table.join(mask, "ordinal", "left_semi"), panel, config.chimera.options))
        frames["chimeras"] = scored
        mask = retained(scored, config.chimera.options)
    if config.selection.enabled:
        mask = select_repertoire(table, config.selection.options, mask, evidence).select("ordinal")
    mask = cut(mask)
    frames["working_set"] = mask
    active = active.join(mask, "ordinal", "left_semi")

    if config.lineage.enabled:
        assigned = cut(assign_lineages(active, config.lineage.options))
        frames["assignments"] = assigned
        frames["lineages"] = lineage_summary(active, assigned, config.lineage.options)
        inherited = inherit_assignments(assigned, members)
        frames["members"] = inherited
        frames["sample_counts"] = sample_counts(base, inherited)
        weighted = active.select("ordinal", F.col("weight").alias("duplicate_count"))
        rows = table.drop("duplicate_count").join(weighted, "ordinal").join(assigned, "ordinal", "left")
        if config.shm.enabled:
            metrics = shm_metrics(rows)
            frames["shm"] = metrics
            frames["shm_by_lineage"] = weighted_distribution(metrics.filter("lineage_id IS NOT NULL"), config.shm.metric, ["lineage_id"])
        if config.missing.enabled:
            frames["missing_alleles"] = missing_alleles(rows.filter("lineage_id IS NOT NULL"), references["V"], config.missing.options)
    return result
