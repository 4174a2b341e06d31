"""Somatic hypermutation of the V segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import CODON_TABLE, clean_alignment, gene_of, number, rounded_count, text, top_call

METRICS = ("v_nt_mutations", "v_nt_rate", "v_aa_replacements", "v_aa_rate", "synonymous", "cdr_nt_rate", "framework_nt_rate")
CDR_REGIONS = ("cdr1", "cdr2")
FRAMEWORK_REGIONS = ("fwr1", "fwr2", "fwr3")


def _first_filled(columns: list[str], *names: str) -> Column:
    present = [text(n) for n in names if n in columns]
    out = F.lit("")
    for c in reversed(present):
        out = F.when(c != "", c).otherwise(out)
    return out


def _position(columns: list[str], name: str) -> Column:
    if name not in columns:
        return F.lit(0)
    return F.greatest(F.lit(0), F.coalesce(F.floor(number(name)), F.lit(0))).cast("int")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


COUNT_FIELDS = (
    "compared_nt", "v_nt_mutations", "compared_codons", "v_aa_replacements", "synonymous",
    "cdr_nt_compared", "cdr_nt_mutations", "framework_nt_compared", "framework_nt_mutations",
)
COUNT_TYPE = ", ".join(f"{name} int" for name in COUNT_FIELDS)

_BASE = np.full(256, 4, dtype=np.int64)
for _code, _letter in enumerate(b"TCAG"):
    _BASE[_letter] = _code
_RESIDUE = np.array([ord(CODON_TABLE[a + b + c]) for a in "TCAG" for b in "TCAG" for c in "TCAG"])


def _letters(texts: list[str], width: int) -> np.ndarray:
    """Texts as a byte matrix, padded with gaps."""
    joined = "".join(t[:width].ljust(width, "-") for t in texts)
    return np.frombuffer(joined.encode("ascii"), dtype=np.uint8).reshape(len(texts), width)


def count_mutations(
    queries: list[str], germlines: list[str], start: np.ndarray, phase: np.ndarray, cdr: np.ndarray, framework: np.ndarray
) -> np.ndarray:
    """The nine counts (see ``COUNT_FIELDS``) of many aligned pairs.

    ``cdr`` and ``framework`` are (reads, regions, 2) query bounds. A codon is compared when
    its three columns are adjacent, ungapped and unambiguous; an insertion or deletion
    skips to the next frame boundary. Columns that are gaps on both sides do not exist.
    """
    lengths = [min(len(a), len(b)) for a, b in zip(queries, germlines, strict=True)]
    cleaned = [(a[:n], b[:n]) for a, b, n in zip(queries, germlines, lengths, strict=True)]
    for i, (a, b) in enumerate(cleaned):
        if "-" in a and "-" in b:
            kept = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
            cleaned[i] = ("".join(x for x, _ in kept), "".join(y for _, y in kept))
    width = max(3, max(len(a) for a, _ in cleaned))
    q, g = _letters([a for a, _ in cleaned], width), _letters([b for _, b in cleaned], width)
    in_q, in_g = q != 45, g != 45
    bq, bg = _BASE[q], _BASE[g]
    valid = (bq < 4) & (bg < 4)
    miss = valid & (bq != bg)
    seen = np.cumsum(in_q, axis=1)
    position = seen + (start - 1)[:, None]

    def within(bounds: np.ndarray) -> np.ndarray:
        inside = np.zeros(q.shape, dtype=bool)
        for r in range(bounds.shape[1]):
            lo, hi = bounds[:, r, 0][:, None], bounds[:, r, 1][:, None]
            inside |= (lo > 0) & (hi >= lo) & (position >= lo) & (position <= hi)
        return inside

    both = in_q & in_g
    closes = both & ((phase[:, None] + seen) % 3 == 0)

    def three(m: np.ndarray) -> np.ndarray:
        return m[:, 2:] & m[:, 1:-1] & m[:, :-2]

    codon = closes[:, 2:] & three(both) & three(valid)
    cq = bq[:, :-2] * 16 + bq[:, 1:-1] * 4 + bq[:, 2:]
    cg = bg[:, :-2] * 16 + bg[:, 1:-1] * 4 + bg[:, 2:]
    changed = codon & (cq != cg)
    silent = changed & (_RESIDUE[np.minimum(cq, 63)] == _RESIDUE[np.minimum(cg, 63)])
    in_cdr, in_framework = within(cdr), within(framework)
    marks = (valid, miss, codon, changed & ~silent, silent, valid & in_cdr, miss & in_cdr, valid & in_framework, miss & in_framework)
    return np.stack([m.sum(axis=1) for m in marks], axis=1)


def mutation_counts():
    """UDF over aligned pairs; ``bounds`` is a flat list of region starts and ends."""
    split = len(CDR_REGIONS)

    @F.pandas_udf(COUNT_TYPE)
    def counts(query: pd.Series, germline: pd.Series, start: pd.Series, phase: pd.Series, bounds: pd.Series) -> pd.DataFrame:
        if not len(query):
            return pd.DataFrame(columns=list(COUNT_FIELDS), dtype="int32")
        parts = []
        for at in range(0, len(query), 1024):
            cut_rows = slice(at, at + 1024)
            regions = np.stack(bounds.iloc[cut_rows].to_list()).reshape(-1, split + len(FRAMEWORK_REGIONS), 2)
            parts.append(
                count_mutations(
                    query.iloc[cut_rows].to_list(), germline.iloc[cut_rows].to_list(), start.iloc[cut_rows].to_numpy(), phase.iloc[cut_rows].to_numpy(),
                    regions[:, :split], regions[:, split:],
                )
            )
        return pd.DataFrame(np.concatenate(parts), columns=list(COUNT_FIELDS)).astype("int32")

    # evaluated once per row, not once per field read from the struct
    return counts.asNondeterministic()


def shm_metrics(table: DataFrame) -> DataFrame:
    """Per-record mutation counts; records without a comparable base are dropped.

    The walk over the columns is the only Python step; it runs on Arrow batches and
    needs no shuffle.
    """
    names = table.columns
    query = clean_alignment(_first_filled(names, "v_sequence_alignment", "sequence_alignment"))
    germline = clean_alignment(_first_filled(names, "v_germline_alignment", "germline_alignment"))
    frame = F.when(_position(names, "sequence_frame") > 0, _position(names, "sequence_frame")).otherwise(_position(names, "v_frame"))
    bounds = [_position(names, f"{r}_{side}") for r in (*CDR_REGIONS, *FRAMEWORK_REGIONS) for side in ("start", "end")]
    weight = F.coalesce(*[F.nullif(text(c), F.lit("")) for c in ("duplicate_count", "consensus_count") if c in names], F.lit("1"))
    sample = F.when(text("sample_id") == "", "Unassigned sample").otherwise(text("sample_id")) if "sample_id" in names else F.lit("Unassigned sample")
    rows = table.select(
        "ordinal",
        *(["lineage_id"] if "lineage_id" in names else []),
        top_call("v_call").alias("v_call"),
        top_call("j_call").alias("j_call"),
        sample.alias("sample_id"),
        rounded_count(weight).alias("weight"),
        query.alias("_q"),
        germline.alias("_g"),
        F.greatest(F.lit(1), _position(names, "v_sequence_start")).alias("_start"),
        F.pmod(F.greatest(F.lit(1), frame) - 1, F.lit(3)).cast("int").alias("_phase"),
        F.array(*bounds).alias("_bounds"),
    )
    # empty texts have no comparable base: testing them here would only work out both texts once more
    counted = rows.withColumn("_s", mutation_counts()("_q", "_g", "_start", "_phase", "_bounds"))
    out = counted.select(
        *[c for c in rows.columns if not c.startswith("_")], *[F.col(f"_s.{name}").alias(name) for name in COUNT_FIELDS]
    ).filter("compared_nt > 0")
    return (
        out.withColumn("v_nt_rate", F.col("v_nt_mutations") / F.col("compared_nt"))
        .withColumn("v_aa_rate", _ratio("v_aa_replacements", "compared_codons"))
        .withColumn("cdr_nt_rate", _ratio("cdr_nt_mutations", "cdr_nt_compared"))
        .withColumn("framework_nt_rate", _ratio("framework_nt_mutations", "framework_nt_compared"))
    )


def weighted_distribution(metrics: DataFrame, metric: str, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Records, abundance, mean, maximum and step quantiles of a metric per group.

    A step quantile is the first value whose cumulative weight reaches ``q`` of the
    total. Equal values are added up first; the cumulative sum then runs over the
    distinct values of a group, which the metric's resolution bounds, not over its rows.
    """
    value = F.col(metric).cast("double")
    per_value = metrics.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("records"), F.sum("weight").alias("weight"))
    totals = per_value.groupBy(*keys).agg(
        F.sum("records").alias("records"),
        F.sum("weight").alias("abundance"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"),
        F.max("value").alias("maximum"),
        F.array_sort(F.collect_list(F.struct("value", "weight"))).alias("steps"),
    )
    out = totals
    for q in quantiles:
        name = "median" if q == 0.5 else f"p{round(q * 100)}"
        target = F.col("abundance") * q
        walked = F.aggregate(
            "steps",
            F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("double").alias("hit")),
            lambda s, x: F.struct(
                (s["total"] + x["weight"]).alias("total"),
                F.coalesce(s["hit"], F.when(s["total"] + x["weight"] >= target, x["value"])).alias("hit"),
            ),
        )
        out = out.withColumn(name, walked["hit"])
    return out.drop("steps")


def lowest_by_lineage(metrics: DataFrame) -> DataFrame:
    """The least mutated member of every lineage."""
    best = metrics.groupBy("lineage_id").agg(F.min(F.struct("v_nt_rate", "v_nt_mutations", "ordinal")).alias("b"))
    return best.select("lineage_id", "b.ordinal", "b.v_nt_rate", "b.v_nt_mutations")


def histogram(metrics: DataFrame, metric: str) -> DataFrame:
    """Twenty equal bins of a rate, or of a count scaled to fifty."""
    value = F.col(metric).cast("double") / F.lit(1.0 if "rate" in metric else 50.0)
    bin_no = F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), value)) * 20).cast("int")
    return metrics.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("records"), F.sum("weight").alias("abundance"))


def by_gene(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("v_gene", gene_of("v_call")).filter("v_gene <> ''")


def lineage_sample_matrix(distribution: DataFrame, statistic: str = "mean", size: int = 32) -> DataFrame:
    """One statistic per (lineage, sample) for the ``size`` most abundant lineages."""
    leading = distribution.groupBy("lineage_id").agg(F.sum("abundance").alias("_a")).orderBy(F.desc("_a"), "lineage_id").limit(size)
    return distribution.join(leading.select("lineage_id"), "lineage_id", "left_semi").select("lineage_id", "sample_id", F.col(statistic).alias("value"))
