"""V(D)J assignment as a sequence of joins.

Reads are seeded against the germlines by a k-mer equi-join, votes are counted per
(read, allele, diagonal) with map-side combining, and only the few alleles per read
that win are aligned. Pairing, D placement, call lists and the junction are then
expressions over one row per read. Equal reads are annotated once.

Germline tables are small; the planner broadcasts them while they are below its size
threshold and shuffles them otherwise. No task ever needs all reads of anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import Scoring, alignment_evalue, local_alignment, map_reference
from ..functions.letters import kmer_codes
from ..functions.sequences import longest_match_run, normalize_nt, reverse_complement, translate_nt
from ..session import cut

SEED_LENGTH = {"V": 9, "D": 5, "J": 7, "C": 9}
BIN = 4
D_LOCI = ("IGH", "TRB", "TRD")


@dataclass(frozen=True)
class AnnotateOptions:
    v_scoring: Scoring = field(default_factory=lambda: Scoring(2, -3, -5, -1))
    d_scoring: Scoring = field(default_factory=lambda: Scoring(2, -3, -13, -1))
    j_scoring: Scoring = field(default_factory=lambda: Scoring(2, -3, -17, -2))
    c_scoring: Scoring = field(default_factory=lambda: Scoring(2, -3, -5, -1))
    top_v: int = 3
    top_d: int = 2
    top_j: int = 2
    top_c: int = 2
    min_v: int = 24
    min_d: int = 6
    min_j: int = 10
    min_c: int = 20
    min_identity: float = 0.6
    band: int = 28
    max_band: int = 256
    max_junction: int = 225
    strand: str = "both"  # or "forward", "reverse"


AGREEMENT_PROFILE = AnnotateOptions(
    d_scoring=Scoring(2, -4, -11, -1), j_scoring=Scoring(2, -4, -13, -1), top_d=3, min_d=5
)


def _germline_seeds(germlines: DataFrame, k: int) -> DataFrame:
    return germlines.select("name", "locus", F.posexplode(kmer_codes(k)("sequence")).alias("at", "gram")).filter("gram >= 0").select(
        F.col("name").alias("gene"), F.col("locus").alias("gene_locus"), "gram", (F.col("at") + 1).alias("gene_at")
    )


def _votes(queries: DataFrame, germlines: DataFrame, k: int, weight: int) -> DataFrame:
    # a window with another letter than A, C, G, T has a number that no germline seed has
    seeds = queries.select("rid", "rev", "want_locus", F.posexplode(kmer_codes(k)("query")).alias("at", "gram")).select(
        "rid", "rev", "want_locus", "gram", (F.col("at") + 1).alias("read_at")
    )
    same = (F.col("want_locus") == "") | (F.col("gene_locus") == "") | (F.col("want_locus") == F.col("gene_locus"))
    hits = seeds.join(_germline_seeds(germlines, k), "gram").filter(same)
    diagonal = F.floor((F.col("read_at") - F.col("gene_at")) / BIN).cast("int") * BIN
    return hits.groupBy("rid", "rev", "gene", diagonal.alias("diagonal")).agg((F.count(F.lit(1)) * weight).alias("votes"))


def seed_candidates(queries: DataFrame, germlines: DataFrame, segment: str, top: int) -> DataFrame:
    """The alleles worth aligning per read: ``rid, rev, gene, diagonal, span, votes``.

    A read whose best diagonal is weak gets a second vote from shorter seeds and keeps
    a wider pool. Alleles with as many votes as the last one kept are kept too, and a read without
    any seed on either strand is aligned to every allele.
    """
    k = SEED_LENGTH[segment]
    primary = _votes(queries, germlines, k, 4)
    strongest = primary.groupBy("rid", "rev").agg(F.max("votes").alias("strongest"))
    threshold = max(32, k * 16)
    strong = strongest.filter(F.col("strongest") >= threshold).select("rid", "rev", F.lit(True).alias("strong"))
    weak_queries = queries.join(strong, ["rid", "rev"], "left_anti")
    rescue = _votes(weak_queries, germlines, k - 2, 1) if k > 4 else primary.limit(0)
    votes = primary.unionByName(rescue).groupBy("rid", "rev", "gene", "diagonal").agg(F.sum("votes").alias("votes"))
    per_gene = votes.groupBy("rid", "rev", "gene").agg(
        F.min_by(F.struct("diagonal", "votes"), F.struct(-F.col("votes"), F.col("diagonal"))).alias("lead"), F.collect_list(F.struct("diagonal", "votes")).alias("bins")
    )
    floor = F.greatest(F.lit(4), F.floor(F.col("lead.votes") / 3))
    spans = F.transform(F.filter("bins", lambda b: b["votes"] >= floor), lambda b: F.abs(b["diagonal"] - F.col("lead.diagonal")))
    ranked = per_gene.withColumn("span", F.coalesce(F.array_max(spans), F.lit(0))).groupBy("rid", "rev").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("lead.votes")).alias("x"), F.col("gene"), F.col("lead.diagonal").alias("diagonal"), F.col("span")))).alias("pool")
    )
    limit = F.when(F.col("strong"), max(top, 3)).otherwise(max(top * 4, 16))
    cutoff = F.element_at("pool", F.least(limit, F.size("pool")))["x"]
    kept = ranked.join(strong, ["rid", "rev"], "left").select("rid", "rev", F.explode(F.filter("pool", lambda c: c["x"] <= cutoff)).alias("c"))
    seeded = kept.select("rid", "rev", "c.gene", "c.diagonal", "c.span", (-F.col("c.x")).alias("votes"))
    # no seed at all: every allele of the panel on the widest band. Reads are dealt over parts and the panel, which does not
    # grow with them, goes to each part, so any number of such reads is spread
    parts = 4 * queries.sparkSession.sparkContext.defaultParallelism
    silent = queries.join(seeded.select("rid").distinct(), "rid", "left_anti").withColumn("panel", F.pmod(F.xxhash64("rid", "rev"), F.lit(parts)).cast("int"))
    alleles = germlines.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("panel"), F.col("name").alias("gene"), F.col("locus").alias("gene_locus"))
    same = (F.col("want_locus") == "") | (F.col("gene_locus") == "") | (F.col("want_locus") == F.col("gene_locus"))
    every = silent.join(alleles, "panel").filter(same)
    return seeded.unionByName(every.select("rid", "rev", "gene", F.lit(0).alias("diagonal"), F.lit(1 << 20).alias("span"), F.lit(0).cast("long").alias("votes")))


def aligned_hits(
    queries: DataFrame, candidates: DataFrame, germlines: DataFrame, scoring: Scoring, top: int, minimum: int, options: AnnotateOptions,
    extend_left: bool = False, extend_right: bool = False,
) -> DataFrame:
    """Best alignments per read as one array ``hits``: the best ``top``, and all with the score of the last of them."""
    genes = germlines.select(F.col("name").alias("gene"), F.col("locus").alias("gene_locus"), F.col("sequence").alias("reference"))
    band = F.greatest(F.lit(options.band), F.least(F.lit(options.max_band), F.col("span") + 8)).cast("int")
    rows = candidates.join(genes, "gene").join(queries.select("rid", "rev", "query"), ["rid", "rev"])
    align = local_alignment(scoring)
    rows = rows.withColumn("a", align("query", "reference", "diagonal", band)).filter("a.score > 0")
    aligned = F.col("a.matches") + F.col("a.mismatches")
    rows = rows.filter((aligned >= minimum) & (F.col("a.matches") / aligned >= options.min_identity))
    # outer bases both strands still have are restored after a terminal mutation
    left = F.least(F.col("a.query_start"), F.col("a.reference_start")) if extend_left else F.lit(0)
    right = (
        F.least(F.length("query") - F.col("a.query_end"), F.length("reference") - F.col("a.reference_end")) if extend_right else F.lit(0)
    )

    def outer(sequence: str, side: str, start: str, end: str) -> Column:
        if side == "left":
            return F.substring(F.col(sequence), F.col(f"a.{start}") - left + 1, left)
        return F.substring(F.col(sequence), F.col(f"a.{end}") + 1, right)

    lq, lr = outer("query", "left", "query_start", "query_end"), outer("reference", "left", "reference_start", "reference_end")
    rq, rr = outer("query", "right", "query_start", "query_end"), outer("reference", "right", "reference_start", "reference_end")
    added = F.filter(
        F.zip_with(F.split(F.concat(lq, rq), ""), F.split(F.concat(lr, rr), ""), lambda q, r: F.struct(q.alias("q"), r.alias("r"))), lambda c: c["q"] != ""
    )
    plain = F.filter(added, lambda c: c["q"].isin("A", "C", "G", "T") & c["r"].isin("A", "C", "G", "T"))
    equal = F.size(F.filter(plain, lambda c: c["q"] == c["r"]))
    gain = equal * scoring.match + (F.size(plain) - equal) * scoring.mismatch
    hit = F.struct(
        (F.col("a.score") + gain).alias("score"),
        (F.col("a.matches") + F.col("a.mismatches") + F.size(added)).alias("aligned"),
        ((F.col("a.matches") + equal) / (F.col("a.matches") + F.col("a.mismatches") + F.size(added))).alias("identity"),
        F.col("gene").alias("gene"),
        F.col("gene_locus").alias("locus"),
        F.length("reference").alias("reference_length"),
        (F.col("a.query_start") - left).alias("query_start"),
        (F.col("a.query_end") + right).alias("query_end"),
        (F.col("a.reference_start") - left).alias("reference_start"),
        (F.col("a.reference_end") + right).alias("reference_end"),
        F.concat(lq, F.col("a.aligned_query"), rq).alias("aligned_query"),
        F.concat(lr, F.col("a.aligned_reference"), rr).alias("aligned_reference"),
        F.col("a.insertions").alias("insertions"),
        F.col("a.deletions").alias("deletions"),
    )
    order = F.struct((-hit["score"]).alias("o1"), (-hit["aligned"]).alias("o2"), (-hit["identity"]).alias("o3"), F.col("gene").alias("o4"), hit.alias("hit"))
    packed = rows.groupBy("rid", "rev").agg(F.array_sort(F.collect_list(order)).alias("all"))
    packed = packed.withColumn("last", F.element_at("all", F.least(F.lit(top), F.size("all")))["o1"]).withColumn("h", F.filter("all", lambda x: x["o1"] <= F.col("last")))
    return packed.select("rid", "rev", F.transform("h", lambda x: x["hit"]).alias("hits"))


def _rearranged(v: Column, j: Column, options: AnnotateOptions) -> Column:
    """Whether a V and a J hit can belong to one rearrangement."""
    faces = (v["reference_end"] + 45 >= v["reference_length"]) & (j["reference_start"] <= 30)
    strong = (v["aligned"] >= 80) & (j["aligned"] >= 30)
    gap = F.greatest(F.lit(0), j["query_start"] - v["query_end"])
    return (
        ((v["locus"] == "") | (j["locus"] == "") | (v["locus"] == j["locus"]))
        & (v["aligned"] + j["aligned"] >= 80)
        & (faces | strong)
        & (v["query_start"] <= j["query_start"])
        & (v["query_end"] <= j["query_start"])
        & (gap <= options.max_junction)
    )


def _call_list(hits: str, selected: Column) -> Column:
    """Names of all hits equal to the selected one in score, length and query span."""
    same = F.filter(
        hits,
        lambda h: (h["score"] == selected["score"]) & (h["aligned"] == selected["aligned"]) & (h["query_start"] == selected["query_start"])
        & (h["query_end"] == selected["query_end"]) & (h["gene"] != selected["gene"])
        & ((h["locus"] == "") | (selected["locus"] == "") | (h["locus"] == selected["locus"])),
    )
    return F.when(selected.isNotNull(), F.array_join(F.concat(F.array(selected["gene"]), F.transform(same, lambda h: h["gene"])), ","))


def _alternative_list(hits: str, selected: Column, call: Column) -> Column:
    """Near-optimal hits outside the call list, in ``call|score|identity|qs|qe|rs|re`` form."""
    tolerance = F.greatest(F.lit(2), F.floor(F.abs(selected["score"]) / 100)).cast("int")
    near = F.filter(hits, lambda h: ~F.array_contains(F.split(call, ","), h["gene"]) & (h["score"] + tolerance >= selected["score"]))
    text = F.transform(
        near,
        lambda h: F.concat_ws(
            "|", h["gene"], h["score"].cast("string"), F.format_number(h["identity"], 6), (h["query_start"] + 1).cast("string"), h["query_end"].cast("string"),
            (h["reference_start"] + 1).cast("string"), h["reference_end"].cast("string"),
        ),
    )
    return F.coalesce(F.array_join(text, ";"), F.lit(""))


def annotate(reads: DataFrame, germlines: DataFrame, options: AnnotateOptions | None = None) -> DataFrame:
    """Annotate ``reads(ordinal, sequence)`` against ``germlines``.

    ``germlines`` has ``segment`` (V, D, J, C), ``name``, ``locus``, ``sequence`` and, where
    known, ``frame``, ``cdr3_stop`` and region bounds (0-based, half-open). Result: one row
    per read with AIRR-style columns.
    """
    o = options or AnnotateOptions()
    genes = {s: germlines.filter(F.col("segment") == s) for s in "VDJC"}
    clean = reads.select("ordinal", normalize_nt("sequence").alias("nt"))
    distinct = cut(clean.filter("nt <> ''").groupBy("nt").agg(F.min("ordinal").alias("rid")))
    turns = {
        "both": F.array(F.struct(F.lit(False).alias("rev"), F.col("nt").alias("query")), F.struct(F.lit(True).alias("rev"), reverse_complement("nt").alias("query"))),
        "forward": F.array(F.struct(F.lit(False).alias("rev"), F.col("nt").alias("query"))),
        "reverse": F.array(F.struct(F.lit(True).alias("rev"), reverse_complement("nt").alias("query"))),
    }[o.strand]
    oriented = distinct.select("rid", F.explode(turns).alias("t")).select("rid", "t.rev", "t.query", F.lit("").alias("want_locus"))

    v_seeds = cut(seed_candidates(oriented, genes["V"], "V", o.top_v))
    j_seeds = cut(seed_candidates(oriented, genes["J"], "J", o.top_j))
    # a strand with far fewer votes is not aligned
    best_v = v_seeds.groupBy("rid", "rev").agg(F.max("votes").alias("n"))
    best_j = j_seeds.groupBy("rid", "rev").agg(F.max("votes").alias("n"))
    strength = best_v.unionByName(best_j).groupBy("rid").agg(
        F.sum(F.when(~F.col("rev"), F.col("n")).otherwise(0)).alias("fwd"), F.sum(F.when(F.col("rev"), F.col("n")).otherwise(0)).alias("bwd")
    )
    loses = (
        strength.select("rid", F.when((F.col("fwd") >= 6) & (F.col("fwd") > F.col("bwd") * 2 + 4), True).when((F.col("bwd") >= 6) & (F.col("bwd") > F.col("fwd") * 2 + 4), False).alias("rev"))
        .filter("rev IS NOT NULL")
    )
    open_reads = cut(oriented.join(loses, ["rid", "rev"], "left_anti"))
    v_hits = aligned_hits(open_reads, v_seeds.join(loses, ["rid", "rev"], "left_anti"), genes["V"], o.v_scoring, o.top_v, o.min_v, o, extend_left=True)
    j_hits = aligned_hits(open_reads, j_seeds.join(loses, ["rid", "rev"], "left_anti"), genes["J"], o.j_scoring, o.top_j, o.min_j, o, extend_right=True)
    both = v_hits.withColumnRenamed("hits", "v_hits").join(j_hits.withColumnRenamed("hits", "j_hits"), ["rid", "rev"], "full_outer")
    nothing = F.filter(F.coalesce("v_hits", "j_hits"), lambda _: F.lit(False))
    both = both.select("rid", "rev", F.coalesce("v_hits", nothing).alias("v_hits"), F.coalesce("j_hits", nothing).alias("j_hits"))
    empty = F.try_element_at(nothing, F.lit(1))
    pairs = F.concat(
        F.flatten(F.transform("v_hits", lambda v, i: F.transform(F.filter("j_hits", lambda j: _rearranged(v, j, o)), lambda j: F.struct((-(v["score"] + j["score"] + 24)).alias("x"), i.alias("i"), v.alias("v"), j.alias("j"))))),
        F.transform("v_hits", lambda v, i: F.struct((-v["score"]).alias("x"), i.alias("i"), v.alias("v"), empty.alias("j"))),
        F.transform("j_hits", lambda j, i: F.struct((-j["score"]).alias("x"), (i + 100).alias("i"), empty.alias("v"), j.alias("j"))),
    )
    paired = both.withColumn("pairs", pairs).withColumn("p", F.array_min(F.transform("pairs", lambda p, k: F.struct(p["x"].alias("x"), k.alias("k")))))
    paired = paired.withColumn("best", F.get("pairs", F.col("p.k"))).filter("best IS NOT NULL")
    paired = cut(
        paired.select("rid", "rev", "v_hits", "j_hits", F.col("best.v").alias("v"), F.col("best.j").alias("j"), (-F.col("best.x")).cast("double").alias("rank"))
        .join(open_reads.select("rid", "rev", "query"), ["rid", "rev"])
    )

    # D between V and J
    locus = F.when(F.col("v.locus") != "", F.col("v.locus")).otherwise(F.col("j.locus"))
    window = F.substring(F.col("query"), F.col("v.query_end") + 1, F.col("j.query_start") - F.col("v.query_end"))
    gaps = paired.filter(F.col("v").isNotNull() & F.col("j").isNotNull() & (locus.isin(*D_LOCI) | (locus == "")) & (F.col("j.query_start") > F.col("v.query_end")))
    d_queries = cut(gaps.select("rid", "rev", window.alias("query"), locus.alias("want_locus"), F.col("v.query_end").alias("shift")))
    d_hits = aligned_hits(d_queries, seed_candidates(d_queries, genes["D"], "D", o.top_d), genes["D"], o.d_scoring, o.top_d, o.min_d, o)
    long_run = F.filter("hits", lambda h: longest_match_run(h["aligned_query"], h["aligned_reference"]) >= o.min_d)
    d_hits = d_hits.join(d_queries.select("rid", "rev", "shift"), ["rid", "rev"]).select(
        "rid", "rev",
        F.transform(long_run, lambda h: h.withField("query_start", h["query_start"] + F.col("shift")).withField("query_end", h["query_end"] + F.col("shift"))).alias("d_hits"),
    )
    # C behind J
    c_queries = paired.filter(F.col("j").isNotNull()).select("rid", "rev", "query", locus.alias("want_locus"), F.col("j.query_end").alias("j_end"))
    c_hits = aligned_hits(c_queries, seed_candidates(c_queries, genes["C"], "C", o.top_c), genes["C"], o.c_scoring, o.top_c, o.min_c, o)
    c_hits = c_hits.join(c_queries.select("rid", "rev", "j_end"), ["rid", "rev"]).select(
        "rid", "rev", F.filter("hits", lambda h: h["query_start"] + 1 >= F.col("j_end")).alias("c_hits")
    )
    called = paired.join(d_hits, ["rid", "rev"], "left").join(c_hits, ["rid", "rev"], "left")
    called = called.withColumn("d", F.try_element_at("d_hits", F.lit(1))).withColumn("c", F.try_element_at("c_hits", F.lit(1)))
    final_rank = F.col("rank") + F.coalesce(F.col("d.score") * 0.5, F.lit(0.0)) + F.coalesce(F.col("c.score") * 0.25, F.lit(0.0))
    called = called.withColumn("rank", final_rank)
    fields = F.struct("rev", "query", "v", "d", "j", "c", "v_hits", "d_hits", "j_hits", "c_hits")
    chosen = called.groupBy("rid").agg(F.min_by(fields, F.struct(-F.col("rank"), F.col("rev"))).alias("w")).select("rid", "w.*")
    annotated = _describe(chosen, genes, o)
    same = clean.join(distinct, "nt", "left").select("ordinal", F.col("nt").alias("sequence"), "rid")
    return same.join(annotated, "rid", "left").drop("rid")


def _describe(chosen: DataFrame, genes: dict[str, DataFrame], o: AnnotateOptions) -> DataFrame:
    """Calls, coordinates, junction and flags from the chosen hits."""
    scoring = {"v": o.v_scoring, "d": o.d_scoring, "j": o.j_scoring, "c": o.c_scoring}
    out = chosen
    # database sizes are scalar subqueries, evaluated once
    for s in "vdjc":
        size = genes[s.upper()].agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("bases"))
        number = genes[s.upper()].agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumns({f"_{s}_bases": size.scalar(), f"_{s}_n": number.scalar()})
    v_meta = genes["V"].select(F.col("name").alias("_vg"), F.col("sequence").alias("_vseq"), F.col("fwr3_end").alias("_vcys"), F.col("frame").alias("_vframe"))
    j_meta = genes["J"].select(F.col("name").alias("_jg"), F.col("sequence").alias("_jseq"), F.col("cdr3_stop").alias("_jstop"))
    out = out.withColumn("_vg", F.col("v.gene")).withColumn("_jg", F.col("j.gene")).join(v_meta, "_vg", "left").join(j_meta, "_jg", "left")

    # conserved anchors: Cys codon closing FWR3, W/F-Gly opening FWR4 (fixed codons)
    cys_ref = F.when((F.col("_vcys") >= 3) & F.substring(F.col("_vseq"), F.col("_vcys") - 2, F.lit(3)).isin("TGT", "TGC"), F.col("_vcys") - 3)
    j_codon = F.substring(F.col("_jseq"), F.col("_jstop") + 2, F.lit(3))
    gly = F.substring(F.col("_jseq"), F.col("_jstop") + 5, F.lit(2))
    j_ref = F.when((F.col("_jstop") >= 0) & j_codon.isin("TGG", "TTT", "TTC") & (gly == "GG"), F.col("_jstop") + 1)

    def project(s: str, position: Column) -> Column:
        h = F.col(s)
        return F.when(position.isNotNull(), map_reference(h["aligned_query"], h["aligned_reference"], h["query_start"], h["reference_start"], position))

    out = out.withColumn("_cys", project("v", cys_ref)).withColumn("_anchor", project("j", j_ref))
    span = F.col("_anchor") - F.col("_cys")
    ok = F.col("_cys").isNotNull() & F.col("_anchor").isNotNull() & (span > 0) & (F.col("_anchor") + 3 <= F.length("query")) & (span <= o.max_junction + 6)
    out = out.withColumn("_ok", F.coalesce(ok, F.lit(False)))

    def cut_query(start: Column, length: Column) -> Column:
        return F.when(F.col("_ok"), F.substring(F.col("query"), start + 1, length)).otherwise("")

    out = out.withColumn("junction", cut_query(F.col("_cys"), span + 3)).withColumn("cdr3", cut_query(F.col("_cys") + 3, span - 3))
    shift = {s: F.pmod(F.col(f"{s}.insertions") - F.col(f"{s}.deletions"), F.lit(3)) != 0 for s in "vj"}
    frame = F.pmod(F.col("_cys"), F.lit(3))
    coding_start = F.col("v.query_start") + F.pmod(frame - F.col("v.query_start"), F.lit(3))
    coding = cut_query(coding_start, F.col("_anchor") + 3 - coding_start)
    stop = translate_nt(coding).contains("*")
    in_frame = F.pmod(span, F.lit(3)) == 0
    flag = lambda c: F.when(F.col("_ok"), F.when(c, "T").otherwise("F")).otherwise("")
    complete = (F.col("v.reference_start") <= 2) & (F.col("j.reference_end") + 3 >= F.col("j.reference_length"))
    plain_phase = F.pmod(F.col("v.query_start") - (F.col("v.reference_start") - F.greatest(F.lit(0), F.coalesce("_vframe", F.lit(0)))), F.lit(3))

    columns: list[Column] = [
        F.col("rid"),
        F.when(F.col("rev"), "T").otherwise("F").alias("rev_comp"),
        F.coalesce(F.nullif(F.col("v.locus"), F.lit("")), F.col("j.locus"), F.lit("")).alias("locus"),
        flag(in_frame & ~stop & ~shift["v"] & ~shift["j"]).alias("productive"),
        flag(in_frame).alias("vj_in_frame"),
        flag(stop).alias("stop_codon"),
        flag(complete).alias("complete_vdj"),
        F.when(F.col("v").isNotNull(), F.when(shift["v"], "T").otherwise("F")).otherwise("").alias("v_frameshift"),
        F.when(F.col("j").isNotNull(), F.when(shift["j"], "T").otherwise("F")).otherwise("").alias("j_frameshift"),
        F.coalesce(F.when(F.col("_ok"), frame + 1), F.when(F.col("v").isNotNull(), plain_phase + 1)).cast("int").alias("sequence_frame"),
        F.col("junction"),
        translate_nt("junction").alias("junction_aa"),
        F.col("cdr3"),
        translate_nt("cdr3").alias("cdr3_aa"),
        F.when(F.col("cdr3") != "", F.col("_cys") + 4).alias("cdr3_start"),
        F.when(F.col("cdr3") != "", F.col("_anchor")).alias("cdr3_end"),
        cut_query(F.col("_anchor"), F.greatest(F.lit(0), F.col("j.query_end") - F.col("_anchor"))).alias("fwr4"),
    ]
    v_end, j_start = F.col("v.query_end"), F.col("j.query_start")
    d_start, d_end = F.col("d.query_start"), F.col("d.query_end")

    def between(a: Column, b: Column) -> Column:
        return F.coalesce(F.when(b > a, F.substring(F.col("query"), a + 1, b - a)), F.lit(""))

    columns += [between(v_end, F.coalesce(d_start, j_start)).alias("np1"), between(d_end, j_start).alias("np2")]
    for s in "vdjc":
        h = F.col(s)
        call = _call_list(f"{s}_hits", h)
        columns += [
            F.coalesce(call, F.lit("")).alias(f"{s}_call"),
            h["score"].alias(f"{s}_score"),
            h["identity"].alias(f"{s}_identity"),
            F.when(h.isNotNull(), alignment_evalue(scoring[s])(h["score"], F.length("query"), F.col(f"_{s}_bases"), F.col(f"_{s}_n"))).alias(f"{s}_support"),
            (h["query_start"] + 1).alias(f"{s}_sequence_start"),
            h["query_end"].alias(f"{s}_sequence_end"),
            (h["reference_start"] + 1).alias(f"{s}_germline_start"),
            h["reference_end"].alias(f"{s}_germline_end"),
            h["aligned_query"].alias(f"{s}_sequence_alignment"),
            h["aligned_reference"].alias(f"{s}_germline_alignment"),
            _alternative_list(f"{s}_hits", h, call).alias(f"{s}_alternatives"),
        ]
    # segments in read order, untemplated stretches as N in the germline
    def part(s: str, previous: Column) -> tuple[Column, Column]:
        h = F.col(s)
        usable = h.isNotNull() & (h["query_start"] >= previous)
        filler = F.substring(F.col("query"), previous + 1, h["query_start"] - previous)
        return (
            F.when(usable, F.concat(filler, h["aligned_query"])).otherwise(""),
            F.when(usable, F.concat(F.repeat(F.lit("N"), h["query_start"] - previous), h["aligned_reference"])).otherwise(""),
        )

    first = F.coalesce(F.col("v.query_start"), F.col("d.query_start"), F.col("j.query_start"))
    after_v = F.coalesce(v_end, first)
    after_d = F.when(F.col("d").isNotNull() & (d_start >= after_v), d_end).otherwise(after_v)
    pieces = [part("v", first), part("d", after_v), part("j", after_d)]
    columns += [F.concat(*[p[0] for p in pieces]).alias("sequence_alignment"), F.concat(*[p[1] for p in pieces]).alias("germline_alignment")]
    return out.select(*columns)


def region_columns(annotated: DataFrame, germlines: DataFrame) -> DataFrame:
    """FWR1–FWR3 and CDR1–CDR2 placed on the read through its V alignment."""
    names = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3")
    bounds = germlines.filter("segment = 'V'").select(F.col("name").alias("_v"), *[F.col(f"{n}_{e}").alias(f"_{n}_{e}") for n in names for e in ("start", "end")])
    rows = annotated.withColumn("_v", F.element_at(F.split("v_call", ","), 1)).join(bounds, "_v", "left")
    read = F.when(F.col("rev_comp") == "T", reverse_complement("sequence")).otherwise(F.col("sequence"))

    def at(position: Column) -> Column:
        return map_reference(F.col("v_sequence_alignment"), F.col("v_germline_alignment"), F.col("v_sequence_start") - 1, F.col("v_germline_start") - 1, position)

    for n in names:
        lo, hi = F.col(f"_{n}_start"), F.col(f"_{n}_end")
        usable = (lo >= 0) & (hi > lo)
        start, end = F.when(usable, at(lo)), F.when(usable, at(hi - 1) + 1)
        rows = rows.withColumn(f"{n}_start", (start + 1).cast("int")).withColumn(f"{n}_end", end.cast("int"))
        rows = rows.withColumn(n, F.coalesce(F.substring(read, F.col(f"{n}_start"), F.col(f"{n}_end") - F.col(f"{n}_start") + 1), F.lit("")))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def balanced_d_filter(annotated: DataFrame, run: int = 5, max_span: int = 11) -> DataFrame:
    """Drop D calls resting on an exact run of five in a short V–J span.

    The composite germline is rebuilt with N where the D had been.
    """
    exact = longest_match_run("d_sequence_alignment", "d_germline_alignment")
    span = F.greatest(F.lit(0), F.col("j_sequence_start") - F.col("v_sequence_end"))
    drop = F.coalesce((F.col("d_call") != "") & (exact == run) & (span <= max_span), F.lit(False))
    rows = annotated.withColumn("_drop", drop)
    gap = F.col("j_sequence_start") - F.col("v_sequence_end") - 1
    rebuilt = F.concat("v_germline_alignment", F.repeat(F.lit("N"), F.greatest(F.lit(0), gap)), "j_germline_alignment")
    rows = rows.withColumn("germline_alignment", F.when(F.col("_drop"), rebuilt).otherwise(F.col("germline_alignment")))
    fields = [c for c in annotated.columns if c.startswith("d_") and c != "d_call"]
    rows = rows.withColumn("d_call", F.when(F.col("_drop"), "").otherwise(F.col("d_call")))
    return rows.withColumns({c: F.when(~F.col("_drop"), F.col(c)) for c in fields}).drop("_drop")


def trim_fwr4(annotated: DataFrame, j_ends: DataFrame) -> DataFrame:
    """Cut FWR4 at the annotated end of the J reference.

    ``j_ends(name, reference_length, end_offset)``: bases beyond FWR4 at the J 3' end.
    """
    ends = j_ends.select(F.col("name").alias("_j"), (F.col("reference_length") - F.col("end_offset")).alias("_target"), F.col("end_offset").alias("_offset"))
    rows = annotated.withColumn("_j", F.element_at(F.split("j_call", ","), 1)).join(ends, "_j", "left")
    last = map_reference(F.col("j_sequence_alignment"), F.col("j_germline_alignment"), F.col("j_sequence_start") - 1, F.col("j_germline_start") - 1, F.col("_target") - 1)
    fwr4_end = F.col("cdr3_end") + F.length("fwr4")
    extra = F.when((F.col("_offset") > 0) & last.isNotNull() & (last + 1 < fwr4_end), fwr4_end - last - 1).otherwise(0)
    kept = F.greatest(F.lit(0), F.length("fwr4") - extra).cast("int")
    return rows.withColumn("fwr4", F.substring(F.col("fwr4"), F.lit(1), kept)).drop("_j", "_target", "_offset")
