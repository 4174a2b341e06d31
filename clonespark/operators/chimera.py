"""PCR-chimera scoring of V (or J) sequences against an aligned germline panel.

A hidden Markov model walks the columns of the panel; switching templates is a
chimera. The table work is Spark's: eligibility, one row per distinct observation,
threading onto the panel by a join. The model itself has no relational form and runs
as an Arrow UDF that advances a whole batch of reads one column at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import unequal_columns
from ..functions.sequences import clean_alignment, gene_of, text, top_call
from ..session import cut

# Default mutation rates of the full model, 0 to 0.25 in equal steps.
MUTATION_RATES = tuple(round(i / 14 * 0.25, 4) for i in range(15))

# A panel is one segment of one locus; every task holds it in memory.
MAX_PANEL_ROWS = 20_000


@dataclass(frozen=True)
class ChimeraOptions:
    segment: str = "V"
    method: str = "BW"  # re-estimated mutation rates, or "DB": a grid of fixed rates
    prior: float = 0.05
    base_mutation: float = 0.05
    rates: tuple[float, ...] = MUTATION_RATES
    rate_switch: float = 0.0
    min_dfr: int = 1
    threshold: float = 0.95
    retain_unevaluated: bool = True
    detailed: bool = False


def _emission_table(panel: np.ndarray, observed: np.ndarray, mutation: np.ndarray, site: int) -> np.ndarray:
    """P(observed base | template) for (reads, templates) at one column."""
    o = observed[:, site][:, None]
    match = panel[None, :, site] == o
    value = np.where(match, 1 - mutation, mutation / 3)
    return np.where((o == ord("-")) | (o == ord("N")), 1.0, value)


def _rescale(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
    total = sum(p.reshape(len(p), -1).sum(axis=1) for p in parts)
    scale = np.where(total > 0, 1 / np.where(total > 0, total, 1), 1.0)
    return tuple(p * scale.reshape((-1,) + (1,) * (p.ndim - 1)) for p in parts)


def estimate_mutation(panel: np.ndarray, observed: np.ndarray, prior: float, base: float) -> np.ndarray:
    """Per read and template: posterior-weighted mutation rate, smoothed by 2 of 12."""
    states, length = panel.shape
    reads = len(observed)
    flat = np.full((reads, states), base)
    switch = prior / length
    other = switch / (states - 1)
    forward = np.empty((length, reads, states))
    current = _emission_table(panel, observed, flat, 0) / states
    forward[0] = current
    for site in range(1, length):
        total = current.sum(axis=1, keepdims=True)
        current = ((total - current) * other + current * (1 - switch)) * _emission_table(panel, observed, flat, site)
        (current,) = _rescale(current)
        forward[site] = current
    backward = np.ones((reads, states))
    mutated, same = np.full((reads, states), 2.0), np.full((reads, states), 10.0)
    for site in range(length - 1, -1, -1):
        posterior = forward[site] * backward
        norm = posterior.sum(axis=1, keepdims=True)
        posterior = np.where(norm > 0, posterior / np.where(norm > 0, norm, 1), 0)
        o = observed[:, site][:, None]
        informative = (o != ord("-")) & (o != ord("N"))
        match = panel[None, :, site] == o
        same += np.where(informative & match, posterior, 0)
        mutated += np.where(informative & ~match, posterior, 0)
        weighted = backward * _emission_table(panel, observed, flat, site)
        total = weighted.sum(axis=1, keepdims=True)
        (backward,) = _rescale(other * (total - weighted) + (1 - switch) * weighted)
    return mutated / (mutated + same)


def chimera_probability(panel: np.ndarray, observed: np.ndarray, prior: float, mutation: np.ndarray) -> np.ndarray:
    """Posterior that a read switched template at least once."""
    states, length = panel.shape
    switch = prior / length
    other = switch / (states - 1)
    single = _emission_table(panel, observed, mutation, 0) / states
    mosaic = np.zeros_like(single)
    for site in range(1, length):
        own = single + mosaic
        total = own.sum(axis=1, keepdims=True)
        emit = _emission_table(panel, observed, mutation, site)
        mosaic = ((total - own) * other + mosaic * (1 - switch)) * emit
        single = single * (1 - switch) * emit
        single, mosaic = _rescale(single, mosaic)
    whole = single.sum(axis=1) + mosaic.sum(axis=1)
    return np.where(whole > 0, mosaic.sum(axis=1) / np.where(whole > 0, whole, 1), 0.0)


def chimera_probability_grid(panel: np.ndarray, observed: np.ndarray, options: ChimeraOptions) -> np.ndarray:
    """The same over templates × fixed mutation rates."""
    references, length = panel.shape
    rates = np.array(options.rates or (0.005,))
    k = len(rates)
    switch = options.prior / length
    stay = 1 - switch - options.rate_switch
    other_reference = switch / ((references - 1) * k)
    other_rate = 0.0 if k == 1 else options.rate_switch / (k - 1)

    def emit(site: int) -> np.ndarray:
        o = observed[:, site][:, None, None]
        match = panel[None, :, site, None] == o
        value = np.where(match, 1 - rates, rates / 3)
        return np.where((o == ord("-")) | (o == ord("N")), 1.0, value)

    single = emit(0) / (references * k)
    mosaic = np.zeros_like(single)
    for site in range(1, length):
        own_s, own_m = single.sum(axis=2, keepdims=True), mosaic.sum(axis=2, keepdims=True)
        total = (own_s + own_m).sum(axis=1, keepdims=True)
        e = emit(site)
        mosaic_next = (mosaic * stay + (own_m - mosaic) * other_rate + (total - own_s - own_m) * other_reference) * e
        single = (single * stay + (own_s - single) * other_rate) * e
        single, mosaic = _rescale(single, mosaic_next)
    whole = single.sum(axis=(1, 2)) + mosaic.sum(axis=(1, 2))
    return np.where(whole > 0, mosaic.sum(axis=(1, 2)) / np.where(whole > 0, whole, 1), 0.0)


def template_path(panel: np.ndarray, observed: np.ndarray, prior: float, mutation: np.ndarray) -> np.ndarray:
    """Most likely template at every column, as (reads, columns)."""
    states, length = panel.shape
    reads = len(observed)
    stay, change = np.log(1 - prior / length), np.log(prior / length / (states - 1))
    with np.errstate(divide="ignore"):
        score = np.log(_emission_table(panel, observed, mutation, 0) / states)
        came = np.zeros((length, reads, states), dtype=np.int32)
        for site in range(1, length):
            best = score.argmax(axis=1)
            jump = score[np.arange(reads), best][:, None] + change
            keep = score + stay
            remain = keep > jump
            remain[np.arange(reads), best] = True
            came[site] = np.where(remain, np.arange(states)[None, :], best[:, None])
            score = np.where(remain, keep, jump) + np.log(_emission_table(panel, observed, mutation, site))
    path = np.empty((reads, length), dtype=np.int32)
    path[:, -1] = score.argmax(axis=1)
    for site in range(length - 1, 0, -1):
        path[:, site - 1] = came[site][np.arange(reads), path[:, site]]
    return path


RESULT_TYPE = "probability double, starting_reference string, recombinations array<struct<position:int,left:string,right:string>>"
_CHUNK = 128


def chimera_model(names: list[str], sequences: list[str], options: ChimeraOptions):
    """UDF threaded observation -> probability and template switches."""
    panel = np.array([list(s.encode("ascii")) for s in sequences], dtype=np.uint8)

    @F.pandas_udf(RESULT_TYPE)
    def model(threaded: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for begin in range(0, len(threaded), _CHUNK):
            part = threaded.iloc[begin : begin + _CHUNK]
            observed = np.array([list(s.encode("ascii")) for s in part], dtype=np.uint8)
            if options.method == "DB":
                mutation = np.full((len(observed), len(panel)), float(np.median(options.rates or (0.005,))))
                probability = chimera_probability_grid(panel, observed, options)
            else:
                mutation = estimate_mutation(panel, observed, options.prior, options.base_mutation)
                probability = chimera_probability(panel, observed, options.prior, mutation)
            if not options.detailed:
                rows += [(float(p), None, []) for p in probability]
                continue
            for p, path in zip(probability, template_path(panel, observed, options.prior, mutation), strict=True):
                switches = np.flatnonzero(path[1:] != path[:-1])
                jumps = [{"position": int(s) + 2, "left": names[path[s]], "right": names[path[s + 1]]} for s in switches]
                rows.append((float(p), names[path[0]], jumps))
        return pd.DataFrame(rows, columns=["probability", "starting_reference", "recombinations"])

    return model.asNondeterministic()


def distance_from_reference(query: Column | str, germline: Column | str) -> Column:
    """Unequal columns over the common length; gaps and N count."""
    return unequal_columns(clean_alignment(query), clean_alignment(germline))


def thread_to_panel():
    """UDF (read, germline, panel row) -> read on the panel's columns.

    Insertions against the germline are dropped; the read fills the non-gap columns of
    the panel row from where its germline part begins, N before it. NULL when the
    germline part does not occur in the panel row.
    """

    @F.pandas_udf(T.StringType())
    def thread(query: pd.Series, germline: pd.Series, gapped: pd.Series) -> pd.Series:
        unknown = {c: "N" for c in range(128) if chr(c) not in "ACGT-"}
        out: list[str | None] = []
        for q, g, row in zip(query, germline, gapped, strict=True):
            local = g.replace("-", "")
            at = row.replace("-", "").find(local) if row is not None and local else -1
            if at < 0:
                out.append(None)
                continue
            read = q.translate(unknown).ljust(len(g), "N")
            filled = iter("N" * at + "".join(c for c, r in zip(read, g, strict=False) if r != "-"))
            out.append("".join("-" if column == "-" else next(filled, "-") for column in row))
        return pd.Series(out, dtype=object)

    return thread.asNondeterministic()


def panel_rows(panel: DataFrame) -> list[tuple[str, str]]:
    """The aligned panel, checked: bounded, rectangular, at least two rows."""
    aligned = F.regexp_replace(F.translate(F.upper(text("sequence")), ".", "-"), "[^ACGTNRYKMSWBDHV-]", "N")
    rows = panel.select(F.trim(text("name")).alias("name"), aligned.alias("sequence")).orderBy("name").limit(MAX_PANEL_ROWS + 1).collect()
    if len(rows) > MAX_PANEL_ROWS:
        raise ValueError(f"An aligned panel holds at most {MAX_PANEL_ROWS} rows; restrict it to one locus and segment.")
    if len(rows) < 2 or len({len(r["sequence"]) for r in rows}) != 1 or not rows[0]["sequence"]:
        raise ValueError("A panel needs at least two aligned sequences of one length.")
    return [(r["name"], r["sequence"]) for r in rows]


def score_chimeras(table: DataFrame, panel: DataFrame, options: ChimeraOptions | None = None) -> DataFrame:
    """``(ordinal, status, dfr, probability, flagged, …)`` for every record.

    Status: evaluated, low_dfr, missing_alignment, missing_reference or error. Equal
    observations are scored once and joined back.
    """
    options = options or ChimeraOptions()
    s = options.segment.lower()
    pairs = panel_rows(panel)
    call = top_call(f"{s}_call")
    rows = table.select(
        "ordinal", call.alias("call"), clean_alignment(f"{s}_sequence_alignment").alias("q"), clean_alignment(f"{s}_germline_alignment").alias("g")
    )
    # All that is decided about an observation is decided once, behind its own row on disk. A filter on the reads would be
    # worked out where the texts are derived, once more for each of its terms.
    present = (F.col("call") != "") & (F.col("q") != "") & (F.col("g") != "")
    observed = cut(rows.select("call", "q", "g").distinct())
    absent = observed.filter(~present).select("call", "q", "g", F.lit("missing_alignment").alias("status"), F.lit(0).alias("dfr"))
    distinct = observed.filter(present).withColumn("dfr", distance_from_reference("q", "g"))
    low = distinct.filter(F.col("dfr") < options.min_dfr).select("call", "q", "g", "dfr", F.lit("low_dfr").alias("status"))

    # panel lookup: exact name first, then any allele of the gene
    aligned = panel.select(
        F.trim(text("name")).alias("name"),
        F.regexp_replace(F.translate(F.upper(text("sequence")), ".", "-"), "[^ACGTNRYKMSWBDHV-]", "N").alias("gapped"),
    )
    # a name may carry several bar-separated labels
    aliases = F.array_distinct(F.concat(F.array("name"), F.filter(F.split("name", r"\|"), lambda f: f.rlike("(?i)(IGH|IGK|IGL|TRA|TRB|TRD|TRG)[VJ]"))))
    exact = aligned.select(F.explode(aliases).alias("call"), "gapped").dropDuplicates(["call"])
    genes = exact.groupBy(gene_of("call").alias("gene")).agg(F.min_by("gapped", "call").alias("by_gene"))
    far = distinct.filter(F.col("dfr") >= options.min_dfr).join(exact, "call", "left").withColumn("gene", gene_of("call")).join(genes, "gene", "left")
    far = far.withColumn("gapped", F.coalesce("gapped", "by_gene"))
    threaded = far.withColumn("threaded", thread_to_panel()("q", "g", "gapped"))
    threaded = cut(threaded)  # two branches read it
    unplaced = threaded.filter(F.col("threaded").isNull()).select(
        "call", "q", "g", "dfr", F.when(F.col("gapped").isNull(), "missing_reference").otherwise("error").alias("status")
    )
    model = chimera_model([n for n, _ in pairs], [x for _, x in pairs], options)
    scored = threaded.filter(F.col("threaded").isNotNull()).select("call", "q", "g", "dfr", F.lit("evaluated").alias("status"), model("threaded").alias("m"))
    scored = scored.select("call", "q", "g", "dfr", "status", "m.*")
    known = scored
    for others in (low, unplaced, absent):
        known = known.unionByName(others, allowMissingColumns=True)
    out = rows.join(known, ["call", "q", "g"]).drop("call", "q", "g")
    return out.withColumn("flagged", (F.col("status") == "evaluated") & (F.col("probability") >= options.threshold))


def retained(scored: DataFrame, options: ChimeraOptions | None = None) -> DataFrame:
    """Records that survive: not flagged, and unevaluated ones when configured."""
    options = options or ChimeraOptions()
    evaluated = F.col("status") == "evaluated"
    return scored.filter(F.when(evaluated, F.col("probability") < options.threshold).otherwise(F.lit(options.retain_unevaluated))).select("ordinal")


def chimera_summary(scored: DataFrame) -> DataFrame:
    """Records per status and tenth of probability."""
    tenth = F.when(F.col("status") == "evaluated", F.least(F.lit(9), F.floor(F.col("probability") * 10))).cast("int")
    return scored.groupBy("status", tenth.alias("bin")).agg(F.count(F.lit(1)).alias("records"))


def visible_sites(scored_pair: DataFrame) -> DataFrame:
    """Per aligned column, how a query relates to its left and right parents."""
    columns = F.arrays_zip(F.split("query", "").alias("q"), F.split("left_parent", "").alias("a"), F.split("right_parent", "").alias("b"))
    rows = scored_pair.select("ordinal", F.posexplode(columns).alias("position", "c"))
    q, a, b = F.col("c.q"), F.col("c.a"), F.col("c.b")
    kind = F.when((q == a) & (q == b), "both").when(q == a, "left").when(q == b, "right").otherwise("neither")
    return rows.select("ordinal", (F.col("position") + 1).alias("position"), kind.alias("site"))
