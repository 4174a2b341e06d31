"""Screening for rearrangements that carry two D segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import dealt, ends_of, flat, pieces
from ..functions.sequences import text
from ..session import cut


@dataclass(frozen=True)
class DoubleDOptions:
    seed: int = 11
    min_vj_span: int = 0  # 40 in long-span mode
    min_gain: int = 8
    pseudo_trim: int = 5
    max_pseudo_mismatches: int = 3
    near_tie: int = 2


def _kmers(sequence: str, k: int) -> Column:
    last = F.length(sequence) - k + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(F.col(sequence), i, F.lit(k)).alias("gram")))
    return F.filter(grams, lambda g: g["gram"].rlike(f"^[ACGT]{{{k}}}$"))


def best_prefixes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and equal letters of the best-scoring common prefix of many pairs, +2 a match and -2 a mismatch.

    A prefix runs from ``a[at]`` and ``b[bt]`` over at most ``counts`` letters, backwards for a ``step`` of -1. The shortest of the best is taken.
    """
    owner, nth = dealt(counts)
    run = ends_of(np.where(a[at[owner] + step * nth] == b[bt[owner] + step * nth], 2, -2))
    first = ends_of(counts)
    run = run[1:] - run[first[:-1]][owner]
    best = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        best[some] = np.maximum(np.maximum.reduceat(run, first[some]), 0)
    length = np.zeros(len(counts), np.int64)
    top = np.flatnonzero((run == best[owner]) & (run > 0))
    who, where = np.unique(owner[top], return_index=True)
    length[who] = nth[top[where]] + 1
    return length, (best // 2 + length) // 2


def _grown(k: int):
    """UDF (window, gene, 1-based places of an exact seed) -> letters it grows by to the left and right, and all equal letters."""

    @F.arrow_udf("l int, r int, matches int")
    def grown(window: pa.Array, sequence: pa.Array, q: pa.Array, g: pa.Array) -> pa.Array:
        texts, genes = window.to_pylist(), sequence.to_pylist()
        places = [x.to_numpy(zero_copy_only=False).astype(np.int64) - 1 for x in (q, g)]
        found = [np.zeros((0, 3), np.int32)]
        for part in pieces(np.fromiter((len(x) + len(y) for x, y in zip(texts, genes, strict=True)), np.int64, len(texts))):
            a, a0 = flat(texts[part])
            b, b0 = flat(genes[part])
            at, bt = places[0][part], places[1][part]
            l, left = best_prefixes(a, a0[:-1] + at - 1, b, b0[:-1] + bt - 1, np.minimum(at, bt), -1)
            rest = np.minimum(np.diff(a0) - at, np.diff(b0) - bt) - k
            r, right = best_prefixes(a, a0[:-1] + at + k, b, b0[:-1] + bt + k, rest, 1)
            found.append(np.stack([l, r, left + right + k], axis=1).astype(np.int32))
        out = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(3)], ["l", "r", "matches"])

    return grown


def d_hits(windows: DataFrame, d_genes: DataFrame, options: DoubleDOptions) -> DataFrame:
    """Ungapped D matches inside the V–J window, grown from exact seeds.

    ``windows(ordinal, window, locus)``; one hit per read, gene and diagonal.
    """
    k = options.seed
    # windows need no test of their letters: the genes' seeds, which they must equal, have been tested
    places = F.sequence(F.lit(1), F.length("window") - k + 1)
    reads = windows.filter(F.length("window") >= k).select("ordinal", "locus", "window", F.explode(places).alias("q")).select(
        "ordinal", "locus", "window", "q", F.substring("window", F.col("q"), F.lit(k)).alias("gram")
    )
    genes = d_genes.select(F.col("name").alias("gene"), F.col("locus").alias("gene_locus"), "sequence", F.explode(_kmers("sequence", k)).alias("s")).select(
        "gene", "gene_locus", "sequence", F.col("s.at").alias("g"), F.col("s.gram").alias("gram")
    )
    same = (F.col("gene_locus") == "") | (F.col("locus") == "") | (F.col("gene_locus") == F.col("locus"))
    seeds = reads.join(genes, "gram").filter(same)
    first = seeds.groupBy("ordinal", "gene", (F.col("q") - F.col("g")).alias("diagonal")).agg(F.min_by(F.struct("window", "sequence", "q", "g"), "q").alias("s"))
    rows = first.select("ordinal", "gene", "s.*").withColumn("w", _grown(k)("window", "sequence", "q", "g")).select("ordinal", "gene", "q", "g", "w.*")
    rows = rows.withColumn("start", F.col("q") - 1 - F.col("l")).withColumn("end", F.col("q") - 1 + k + F.col("r")).withColumn("gene_start", F.col("g") - 1 - F.col("l"))
    return rows.select("ordinal", "gene", "start", "end", "gene_start", "matches", (F.col("matches") * 4 - (F.col("end") - F.col("start")) * 2).alias("score"))


def screen_double_d(windows: DataFrame, d_genes: DataFrame, options: DoubleDOptions | None = None) -> DataFrame:
    """The best ordered, non-overlapping D pair per read that beats any single D.

    A pair is dropped when its whole outer span, less a few bases, is nearly contained
    in one germline D: that is one D read twice. A read has few hits, so its pairs are
    formed inside one row. Reads of equal window and locus have the same pair: each
    distinct window is screened once.
    """
    o = options or DoubleDOptions()
    usable = windows.filter((F.length("window") >= 2 * o.seed) & (F.length("window") >= o.min_vj_span) & F.col("locus").isin("IGH", "TRB", "TRD"))
    texts = cut(usable.select("window", "locus").distinct().withColumn("ordinal", F.monotonically_increasing_id()))
    screened = _screen_distinct(texts, d_genes, o).withColumnRenamed("ordinal", "text")
    owners = usable.select("ordinal", "window", "locus").join(texts.withColumnRenamed("ordinal", "text"), ["window", "locus"]).select("ordinal", "text")
    return owners.join(screened, "text").drop("text")


def _screen_distinct(windows: DataFrame, d_genes: DataFrame, o: DoubleDOptions) -> DataFrame:
    """``screen_double_d`` for usable windows that are on disk."""
    hits = cut(d_hits(windows, d_genes, o))  # read four times
    # bounded by (read length x number of D alleles)
    per_read = hits.groupBy("ordinal").agg(F.collect_list(F.struct("start", "end", "score", "gene", "matches", "gene_start")).alias("h"), F.max("score").alias("single"))
    listed = F.flatten(
        F.transform("h", lambda a: F.transform(F.filter("h", lambda b: (b["start"] >= a["end"]) & (a["score"] + b["score"] - F.col("single") >= o.min_gain)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    pairs = per_read.select("ordinal", "single", F.explode(listed).alias("p")).select("ordinal", "single", "p.a", "p.b")
    pairs = pairs.join(windows.select("ordinal", "window", "locus"), "ordinal")
    span = F.substring(F.col("window"), F.col("a.start") + 1, F.col("b.end") - F.col("a.start"))
    spans = pairs.select(span.alias("span"), "locus").distinct()
    twice = _contained_spans(spans, d_genes, o)
    kept = pairs.withColumn("span", span).join(twice, ["span", "locus"], "left_anti")
    order = F.struct(
        -(F.col("a.score") + F.col("b.score")), -(F.col("a.matches") + F.col("b.matches")), F.col("b.start") - F.col("a.end"),
        F.concat("a.gene", "b.gene"), F.col("a.start"), F.col("b.start"),
    )
    best = kept.groupBy("ordinal").agg(F.min_by(F.struct("a", "b", "single", F.length("window").alias("vj_span")), order).alias("w"))
    all_hits = hits.select("ordinal", F.struct("start", "end", "score", "gene_start").alias("place"), "gene")
    out = best.select(
        "ordinal", F.struct("w.a.start", "w.a.end", "w.a.score", "w.a.gene_start").alias("p1"), F.struct("w.b.start", "w.b.end", "w.b.score", "w.b.gene_start").alias("p2"),
        (F.col("w.a.score") + F.col("w.b.score")).alias("pair_score"), F.col("w.single").alias("single_score"), F.col("w.vj_span").alias("vj_span"),
        (F.col("w.b.start") - F.col("w.a.end")).alias("inter_d_length"),
    )

    def named(place: str, alias: str) -> DataFrame:
        return out.select("ordinal", F.col(place).alias("place")).join(all_hits, ["ordinal", "place"]).groupBy("ordinal").agg(
            F.array_join(F.array_sort(F.collect_set("gene")), ",").alias(alias)
        )

    joined = out.join(named("p1", "d_call"), "ordinal").join(named("p2", "d2_call"), "ordinal")
    return joined.select(
        "ordinal", "d_call", "d2_call", F.col("p1.start").alias("d_start"), F.col("p1.end").alias("d_end"), F.col("p2.start").alias("d2_start"), F.col("p2.end").alias("d2_end"),
        "pair_score", "single_score", (F.col("pair_score") - F.col("single_score")).alias("score_gain"), "vj_span", "inter_d_length",
    )


def _contained_spans(spans: DataFrame, d_genes: DataFrame, o: DoubleDOptions) -> DataFrame:
    """Outer spans that one germline D nearly explains (few mismatches over span - trim).

    With at most m mismatches one of m + 1 blocks of the compared stretch is exact, so
    span and gene meet on a block before positions are compared.
    """
    length = F.length("span") - o.pseudo_trim
    rows = spans.filter(length >= o.seed).select(
        "span", "locus", length.alias("n"), F.explode(F.sequence(F.lit(1), F.lit(o.pseudo_trim + 1))).alias("from")
    ).withColumn("part", F.substring(F.col("span"), F.col("from"), F.col("n")))
    m = o.max_pseudo_mismatches
    start = lambda i: F.floor(i * F.col("n") / (m + 1)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(m)), lambda i: F.struct(start(i).alias("at"), F.substring(F.col("part"), start(i) + 1, start(i + 1) - start(i)).alias("block"))
    )
    keyed = rows.select("span", "locus", "n", "part", F.explode(blocks).alias("b")).select("span", "locus", "n", "part", "b.at", "b.block")
    # every substring of a D gene, a few hundred per allele: blocks then meet by equality
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("sequence")),
            lambda w: F.transform(F.sequence(F.lit(1), F.length("sequence") - w + 1), lambda i: F.struct((i - 1).alias("p"), F.substring(F.col("sequence"), i, w).alias("block"))),
        )
    )
    genes = d_genes.select(F.col("locus").alias("gene_locus"), "sequence").distinct()
    windows = genes.select("gene_locus", "sequence", F.explode(cuts).alias("c")).select("gene_locus", "sequence", "c.p", "c.block")
    met = keyed.join(windows, "block").filter((F.col("gene_locus") == "") | (F.col("locus") == "") | (F.col("gene_locus") == F.col("locus")))
    begin = F.col("p") - F.col("at")
    met = met.filter((begin >= 0) & (begin + F.col("n") <= F.length("sequence")))
    other = F.substring(F.col("sequence"), begin + 1, F.col("n"))
    distance = F.size(F.filter(F.zip_with(F.split("part", ""), F.split(other, ""), lambda x, y: x != y), lambda t: t))
    return met.filter(distance <= m).select("span", "locus").distinct()


def merge_sidecar(table: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Left join of the sparse second-D table; its non-empty cells replace the row's."""
    shared = [c for c in sidecar.columns if c in table.columns and c != "ordinal"]
    extra = [c for c in sidecar.columns if c not in table.columns]
    side = sidecar.select("ordinal", *[F.col(c).alias(f"_{c}") for c in shared], *extra)
    joined = table.join(side, "ordinal", "left")
    return joined.select(
        *[F.when(text(f"_{c}") != "", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in table.columns], *extra
    )


def pair_counts(sidecar: DataFrame, limit: int | None = 12) -> DataFrame:
    """Reads per ordered D pair, most frequent first."""
    counts = sidecar.filter((text("d2_call") != "")).groupBy("d_call", "d2_call").agg(F.count(F.lit(1)).alias("records"))
    return counts if limit is None else counts.orderBy(F.desc("records"), "d_call", "d2_call").limit(limit)


def explore_sidecar(sidecar: DataFrame, records: DataFrame, *, d1: str = "", d2: str = "", cdr3: str = "", sequence_id: str = "", min_gain: int = 0, min_span: int = 0) -> DataFrame:
    """Sidecar rows with their CDR3, filtered by text, score gain and V–J span."""
    rows = sidecar.join(records.select("ordinal", "sequence_id", "cdr3", "cdr3_aa"), "ordinal", "left")

    def has(column: str, wanted: str) -> Column:
        return F.upper(text(column)).contains(wanted.strip().upper()) if wanted.strip() else F.lit(True)

    either = (has("cdr3", cdr3) | has("cdr3_aa", cdr3)) if cdr3.strip() else F.lit(True)
    return rows.filter(has("d_call", d1) & has("d2_call", d2) & has("sequence_id", sequence_id) & either & (F.col("score_gain") >= min_gain) & (F.col("vj_span") >= min_span))
