"""Bounded samples of every group, however large one group is.

The first ``limit`` rows of a group are those of its parts' first ``limit`` rows: groups are cut
into salted parts, each part is ranked alone, and only survivors meet in the final ranking. A part that holds
a third of all rows is thus spread like any other, and no task sorts more than its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], limit: int, key: str = "ordinal", parts: int | None = None) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, which must be total, with ``nth`` from one.

    ``parts`` is how many parts a group has in the first ranking: by default so many that a part of a table in one group is
    no more than the share of one core, but no more than leave ``limit`` rows a core to the final ranking.
    """
    if limit < 1:
        return rows.withColumn("nth", F.lit(1)).limit(0)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = parts or max(2, math.ceil(math.sqrt(cores)) * 4)
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    own = Window.partitionBy(*group, "part of group").orderBy(*order)
    kept = rows.withColumn("part of group", part).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= limit).drop("nth", "part of group")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("nth") <= limit)


def capped_sample(rows: DataFrame, limit: int = 2000, lineage: str = "lineage_id", sample: str = "sample_id", key: str = "ordinal") -> DataFrame:
    """The first ``limit`` records of each sample of each lineage, so that no early time point fills a lineage."""
    return first_per_group(rows, [lineage, sample], [F.col(key)], limit, key).drop("nth")


def member_sample(assignments: DataFrame, limit: int, lineages: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """A uniform sample of up to ``limit`` members of each lineage, with the number of all: ``lineage_id, ordinal, total``.

    The ``limit`` smallest salted hashes are the sample, the same whatever the order or partitioning; smaller lineages
    are whole. ``lineages`` restricts the answer to some ``lineage_id``.
    """
    chosen = assignments.select("lineage_id", "ordinal")
    if lineages is not None:
        chosen = chosen.join(lineages.select("lineage_id").distinct(), "lineage_id", "left_semi")
    salted = chosen.withColumn("salted hash", F.md5(F.concat_ws("\t", F.lit(str(seed)), F.col("lineage_id").cast("string"), F.col("ordinal").cast("string"))))
    picked = first_per_group(salted, ["lineage_id"], [F.col("salted hash"), F.col("ordinal")], limit).drop("nth", "salted hash")
    totals = chosen.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("total"))
    return picked.join(totals, "lineage_id")
