"""Error-aware collapse: erroneous variants join the abundant variant they came from.

The rules are sequential by definition: variants are visited from most to least
abundant and only a variant that was not itself merged may act as a parent. Doing
that inside one task per V/J partition would put a dominant partition on a single
core, so the work is split differently:

1. candidate (child, parent) pairs come from an exact similarity join;
2. implausible pairs are dropped, each decided from its own two rows;
3. the visiting order is resolved by rounds over the remaining edges. A variant
   none of whose possible parents is still undecided can be decided, and its
   children follow in the next round. The result equals the sequential scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import edit_profile
from ..functions.sequences import blocks, call_set
from ..functions.statistics import alternative_count, exact_error_rate, poisson_upper_tail
from ..session import cut
from .centroids import KMER, nearest_centroids, squared_profile_distance
from .collapse import constant_partition
from .simjoin import HOT_GROUP, edit_pairs, hamming_pairs
from .study import scope_key


@dataclass(frozen=True)
class DenoiseOptions:
    mode: str = "conservative"  # or "indel", "abundance"
    error_rate: float = 0.00473
    alpha: float = 0.01
    resolution: str = "allele"
    ambiguity: str = "strict"
    min_parent_count: int = 2
    ambiguous: str = "exclude"  # reads with N: or "retain"
    unresolved: str = "discard"  # reads without calls or sequence: or "retain"
    max_hamming: int = 1
    max_edit: int = 2
    min_indel_ratio: float = 2.0
    kmer_threshold: float = 1.0
    kmer_method: int = 2
    zero_error_fraction: float = 1.0
    scope: str = "sample"
    respect_constant: bool = True
    hot_group: int = HOT_GROUP

    def __post_init__(self) -> None:
        if not (0 < self.error_rate < 1 and 0 < self.alpha < 1):
            raise ValueError("error_rate and alpha must lie between 0 and 1")
        if not 1 <= self.max_hamming <= 4 or self.max_edit not in (1, 2):
            raise ValueError("the Hamming radius is 1 to 4 and the edit radius 1 or 2")
        if self.min_indel_ratio <= 1 or self.kmer_threshold < 0:
            raise ValueError("the indel ratio must exceed 1 and the k-mer radius be non-negative")


def _partitioned(records: DataFrame, options: DenoiseOptions) -> DataFrame:
    v = call_set("v_call", options.resolution, options.ambiguity)
    j = call_set("j_call", options.resolution, options.ambiguity)
    part = F.concat_ws(
        "\t", scope_key(options.scope), constant_partition(options.respect_constant),
        F.when(F.col("locus") == "", "?").otherwise(F.col("locus")), F.concat_ws("+", v), F.concat_ws("+", j),
    )
    usable = (F.size(v) > 0) & (F.size(j) > 0) & (F.col("denoise_nt") != "")
    kind = (
        F.when(~usable, "unresolved").when(F.col("denoise_nt").contains("N"), "ambiguous").otherwise("clean")
    )
    return records.select("ordinal", "weight", part.alias("part"), F.col("denoise_nt").alias("seq"), kind.alias("kind"))


def variants(records: DataFrame, options: DenoiseOptions) -> DataFrame:
    """Distinct clean sequences per partition: ``id, part, seq, count``."""
    clean = _partitioned(records, options).filter("kind = 'clean'")
    return clean.groupBy("part", "seq").agg(F.min("ordinal").alias("id"), F.sum("weight").alias("count"))


def _edges(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate pairs with both variants' counts and sequences attached."""
    child = pool.select(F.col("id").alias("child"), F.col("count").alias("child_count"), F.col("seq").alias("child_seq"))
    parent = pool.select(F.col("id").alias("parent"), F.col("count").alias("parent_count"), F.col("seq").alias("parent_seq"))
    return pairs.join(child, "child").join(parent, "parent")


def earlier(count: str, other: str, key: str, other_key: str) -> Column:
    """Visiting order: larger count first, then the earlier record."""
    return (F.col(count) > F.col(other)) | ((F.col(count) == F.col(other)) & (F.col(key) < F.col(other_key)))


def merged_children(edges: DataFrame) -> DataFrame:
    """Which variants are merged, given plausible ``(child, parent)`` edges.

    A variant is merged exactly when one of its possible parents is not merged.
    Each round settles the variants whose parents are all settled roots.
    """
    open_edges = cut(edges.select("child", "parent"))
    settled: DataFrame | None = None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("child").alias("parent")).distinct()
        merged = cut(open_edges.join(waiting, "parent", "left_anti").select("child").distinct())
        settled = merged if settled is None else settled.union(merged)
        still = open_edges.join(merged, "child", "left_anti")
        open_edges = cut(still.join(merged.select(F.col("child").alias("parent")), "parent", "left_anti"))
    return edges.select("child").limit(0) if settled is None else settled


def _best_parent(edges: DataFrame, order: Column) -> DataFrame:
    merged = merged_children(edges)
    roots_only = edges.join(merged.select(F.col("child").alias("parent")), "parent", "left_anti")
    return roots_only.groupBy("child").agg(F.min_by(F.struct("parent", "indel"), order).alias("best")).select(
        F.col("child").alias("id"), F.col("best.parent").alias("target"), F.col("best.indel").alias("indel")
    )


def conservative_targets(pool: DataFrame, options: DenoiseOptions) -> DataFrame:
    """Substitution-only model: the parent expected to produce the child most often."""
    d = options.max_hamming
    probe = pool.select("id", "part", "seq", F.lit(d).alias("lim"))
    indexed = pool.filter(F.col("count") >= options.min_parent_count).select("id", "part", "seq", F.lit(d).alias("lim"))
    pairs = hamming_pairs(probe, indexed, hot_group=options.hot_group).select(
        F.col("left_id").alias("child"), F.col("right_id").alias("parent"), "distance"
    )
    edges = _edges(pairs.filter("distance >= 1"), pool).filter(earlier("parent_count", "child_count", "parent", "child"))
    length = F.length("child_seq")
    rate = exact_error_rate(F.col("parent_count"), length, F.col("distance"), options.error_rate)
    scored = edges.withColumn("rate", rate).withColumn("tail", poisson_upper_tail(F.col("child_count").cast("double"), F.col("rate")))
    adjusted = F.least(F.lit(1.0), F.col("tail") * alternative_count(length, F.col("distance"), d))
    shared = F.array_position(
        F.zip_with(blocks("child_seq", F.lit(d + 1)), blocks("parent_seq", F.lit(d + 1)), lambda a, b: a == b), True
    )
    plausible = cut(
        scored.filter(adjusted >= options.alpha).select(
            "child", "parent", "distance", "rate", shared.alias("shared"), F.lit(False).alias("indel")
        )
    )
    return _best_parent(plausible, F.struct(-F.col("rate"), "distance", "shared", "parent"))


def indel_targets(pool: DataFrame, options: DenoiseOptions) -> DataFrame:
    """Indel-aware model: the closest plausible and strictly more abundant parent."""
    limit = options.max_edit
    indexed = pool.filter(F.col("count") >= options.min_parent_count)
    pairs = edit_pairs(pool, indexed, limit=limit, hot_group=options.hot_group, above="count").select(
        F.col("left_id").alias("child"), F.col("right_id").alias("parent")
    )
    edges = _edges(pairs, pool)
    profiled = edges.withColumn("p", edit_profile(limit)(F.col("parent_seq"), F.col("child_seq"))).filter("p.distance >= 1")
    length, subs = F.length("child_seq"), F.col("p.substitutions")
    indels = F.col("p.insertions") + F.col("p.deletions")
    rate = exact_error_rate(F.col("parent_count"), length, subs, options.error_rate)
    scored = profiled.withColumn("tail", poisson_upper_tail(F.col("child_count").cast("double"), rate))
    adjusted = F.least(F.lit(1.0), F.col("tail") * alternative_count(length, subs, limit))
    plausible = F.when(indels > 0, F.col("parent_count") / F.col("child_count") >= options.min_indel_ratio).otherwise(
        adjusted >= options.alpha
    )
    kept = cut(
        scored.filter(plausible).select(
            "child", "parent", "parent_count", F.col("p.distance").alias("distance"), subs.alias("subs"), (indels > 0).alias("indel")
        )
    )
    return _best_parent(kept, F.struct("distance", "subs", -F.col("parent_count"), "parent"))


def kmer_block_tokens(block_count: int):
    """UDF sequence -> one token per k-mer block.

    k-mers fall into ``block_count`` blocks by code. A token changes only if some
    count in its block does, so profiles within squared distance r differ in at
    most r tokens.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(sequence: pd.Series) -> pd.Series:
        code = np.zeros(256, dtype=np.int64)
        code[ord("C")], code[ord("G")], code[ord("T")] = 1, 2, 3

        def of(s: str) -> list[str]:
            bases = code[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]
            parts: list[list[str]] = [[] for _ in range(block_count)]
            if len(bases) >= KMER:
                windows = np.lib.stride_tricks.sliding_window_view(bases, KMER)
                codes, counts = np.unique(windows @ (4 ** np.arange(KMER - 1, -1, -1)), return_counts=True)
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    parts[c % block_count].append(f"{c}x{n}")
            return [f"{i}:" + ",".join(p) for i, p in enumerate(parts)]

        return sequence.map(of)

    return tokens


def kmer_pairs(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """``(left_id, right_id, squared)`` of all pairs within a squared k-mer radius.

    With B blocks two matching profiles share at least B - r tokens, so under any
    common order of tokens their first r + 1 must intersect. Ordering by rarity makes
    those the most selective ones: a token shared by a whole V gene is never a join
    key unless everything else about the sequence is as common.
    """
    block_count = 4 * (radius + 1)
    tokens = kmer_block_tokens(block_count)

    def tokenised(side: DataFrame) -> DataFrame:
        return side.select("id", "part", F.explode(tokens("seq")).alias("token")).withColumn("token", F.xxhash64("token"))

    token_l, token_r = tokenised(left), tokenised(right)
    frequency = token_l.unionByName(token_r).groupBy("part", "token").agg(F.count(F.lit(1)).alias("n"))

    def prefix(side: DataFrame) -> DataFrame:
        # the array holds block_count tokens of one sequence, never a group of rows
        ranked = side.join(frequency, ["part", "token"]).groupBy("id", "part").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, radius + 1).alias("kept")
        )
        return ranked.select("id", "part", F.explode("kept.token").alias("token"))

    a = prefix(token_l).withColumnRenamed("id", "left_id")
    b = prefix(token_r).withColumnRenamed("id", "right_id")
    candidates = a.join(b, ["part", "token"]).filter("left_id <> right_id").select("left_id", "right_id").distinct()
    with_seq = candidates.join(left.select(F.col("id").alias("left_id"), F.col("seq").alias("ls")), "left_id").join(
        right.select(F.col("id").alias("right_id"), F.col("seq").alias("rs")), "right_id"
    )
    return with_seq.withColumn("squared", squared_profile_distance()("ls", "rs")).filter(F.col("squared") <= radius).select(
        "left_id", "right_id", "squared"
    )


def abundance_targets(pool: DataFrame, options: DenoiseOptions) -> DataFrame:
    """k-mer abundance model: pick templates, then send the rest to the nearest one.

    Among the variants above the parent floor, visited by abundance, one is a
    template unless its most abundant template neighbour explains it.
    """
    radius = max(0, int(np.floor(12 * options.kmer_threshold + 1e-9)))
    seeds = cut(pool.filter(F.col("count") >= options.min_parent_count))
    near = kmer_pairs(seeds, seeds, radius).select(F.col("left_id").alias("child"), F.col("right_id").alias("parent"), "squared")
    edges = _edges(near, seeds).filter(earlier("parent_count", "child_count", "parent", "child"))
    rate = F.col("parent_count") / F.lit(options.zero_error_fraction) * F.lit(options.error_rate)
    tail = poisson_upper_tail(F.col("child_count").cast("double"), rate)
    scored = edges.withColumn("tail", tail)
    adjusted = F.least(F.lit(1.0), F.col("tail") * F.greatest(F.lit(1), F.length("child_seq")))
    template = (adjusted < options.alpha) if options.kmer_method == 2 else F.lit(False)
    rank = F.struct(-F.col("parent_count"), "squared", "parent")
    open_edges = cut(scored.select("child", "parent", template.alias("template"), rank.alias("rank")))
    rejected: DataFrame | None = None
    while not open_edges.isEmpty():
        first = open_edges.groupBy("child").agg(F.min_by(F.struct("parent", "template"), "rank").alias("f"))
        waiting = open_edges.select(F.col("child").alias("parent")).distinct()
        decided = cut(
            first.select("child", "f.parent", "f.template").join(waiting, "parent", "left_anti").select("child", "template")
        )
        out = decided.filter(~F.col("template")).select("child")
        rejected = out if rejected is None else rejected.union(out)
        still = open_edges.join(decided, "child", "left_anti")
        open_edges = cut(still.join(out.select(F.col("child").alias("parent")), "parent", "left_anti"))
    accepted = seeds.select("id", "part", "seq", "count")
    if rejected is not None:
        accepted = accepted.join(rejected.select(F.col("child").alias("id")), "id", "left_anti")
    # a partition in which nothing reaches the floor keeps its first variant
    bare = pool.join(seeds.select("part").distinct(), "part", "left_anti")
    lead = bare.groupBy("part").agg(F.min_by(F.struct("id", "seq", "count"), F.struct(-F.col("count"), "id")).alias("v"))
    accepted = cut(accepted.unionByName(lead.select("v.id", "part", "v.seq", "v.count")))

    pending = cut(pool.join(accepted.select("id"), "id", "left_anti").select("id", "part", "seq"))
    return nearest_centroids(pending, accepted).select("id", "target", F.lit(False).alias("indel"))


def denoise_targets(pool: DataFrame, options: DenoiseOptions) -> DataFrame:
    """``(id, target, indel)`` for the merged variants only."""
    return {"conservative": conservative_targets, "indel": indel_targets, "abundance": abundance_targets}[options.mode](pool, options)


def denoise(records: DataFrame, options: DenoiseOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and members of a denoised repertoire.

    Returns ``(representative, count)`` and ``(ordinal, representative)``; the
    latter is NULL for discarded reads.
    """
    options = options or DenoiseOptions()
    rows = _partitioned(records, options)
    pool = cut(variants(records, options))
    merged = cut(denoise_targets(pool, options))
    owner = pool.join(merged.select("id", "target"), "id", "left").select(
        "part", "seq", "count", F.coalesce("target", "id").alias("representative")
    )
    groups = owner.groupBy("representative").agg(F.sum("count").alias("count"))
    members = rows.filter("kind = 'clean'").join(owner.select("part", "seq", "representative"), ["part", "seq"]).select(
        "ordinal", "representative"
    )
    nothing = F.lit(None).cast("bigint")
    ambiguous = rows.filter("kind = 'ambiguous'")
    if options.ambiguous == "retain":
        same = ambiguous.groupBy("part", "seq").agg(F.min("ordinal").alias("representative"), F.sum("weight").alias("count"))
        groups = groups.unionByName(same.select("representative", "count"))
        members = members.unionByName(ambiguous.join(same.drop("count"), ["part", "seq"]).select("ordinal", "representative"))
    else:
        members = members.unionByName(ambiguous.select("ordinal", nothing.alias("representative")))
    unresolved = rows.filter("kind = 'unresolved'")
    if options.unresolved == "retain":
        groups = groups.unionByName(unresolved.select(F.col("ordinal").alias("representative"), F.col("weight").alias("count")))
        members = members.unionByName(unresolved.select("ordinal", F.col("ordinal").alias("representative")))
    else:
        members = members.unionByName(unresolved.select("ordinal", nothing.alias("representative")))
    return groups, members
