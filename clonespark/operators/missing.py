"""Screening for germline V alleles that the reference set lacks.

Pass one looks, per V allele, for substitutions shared by independent lineages and
links those that travel together. Pass two revisits every member of the supporting
lineages: a member that still shows the reference base vetoes its lineage.

Lineages never gather in one place. They are reduced to *patterns*, the set of
passing substitutions a lineage supports and the set it covers, with a count; the
greedy linkage then needs only conditional sums over patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import clean_alignment, hotspot, normalize_nt, number, text, top_call
from ..functions.statistics import binomial_survival, mutation_null_probability
from ..session import cut


@dataclass(frozen=True)
class MissingOptions:
    min_units: int = 6
    min_covered: int = 20
    min_fraction: float = 0.2
    max_shm: float = 0.08
    min_aligned: int = 180
    max_snps: int | None = None  # a bound ends linkage early, so a longer haplotype comes out short
    max_p: float = 1e-6
    min_j_calls: int = 3
    min_junction_lengths: int = 3
    min_cdr3s: int = 6
    min_linked: float = 0.9
    min_near_germline: int = 3
    max_other_alternate: float = 0.02


def observations(table: DataFrame) -> DataFrame:
    """One row per assigned, aligned record.

    ``events`` lists substitutions as ``position:ref>alt`` in germline coordinates,
    ``bases`` is the observed base at every germline position from ``first`` on, with
    ``.`` where the pair is not comparable, and ``expected`` the germline base.
    """
    q, g = clean_alignment("v_sequence_alignment"), clean_alignment("v_germline_alignment")
    start = F.floor(number("v_germline_start"))
    rows = table.select(
        "ordinal", "lineage_id", top_call("v_call").alias("v_call"), top_call("j_call").alias("j_call"),
        F.when(F.trim(text("subject_id")) == "", "unassigned-subject").otherwise(F.trim(text("subject_id"))).alias("subject_id"),
        normalize_nt("cdr3").alias("cdr3"),
        q.alias("q"), g.alias("g"), F.least(F.length(q), F.length(g)).alias("n"),
        F.when(start > 0, start).otherwise(1).cast("int").alias("first"),
    ).filter(F.col("lineage_id").isNotNull() & (F.col("v_call") != "") & (F.col("n") > 0))
    rows = rows.withColumn("_o", germline_view()("q", "g", "first")).select(
        *[c for c in rows.columns if c not in ("q", "g", "n")], "_o.bases", "_o.expected", "_o.events", "_o.aligned"
    )
    rate = F.when(F.col("aligned") > 0, F.size("events") / F.col("aligned")).otherwise(1.0)
    return rows.withColumn("rate", rate)


VIEW_TYPE = "bases string, expected string, events array<struct<position:int,ref:string,alt:string>>, aligned int"


def germline_view():
    """UDF aligned pair -> observed and germline letters per germline position."""

    @F.pandas_udf(VIEW_TYPE)
    def view(query: pd.Series, germline: pd.Series, first: pd.Series) -> pd.DataFrame:
        known = np.zeros(256, dtype=bool)
        known[[65, 67, 71, 84]] = True
        rows = []
        for q, g, start in zip(query, germline, first, strict=True):
            n = min(len(q), len(g))
            a, b = (np.frombuffer(x.encode("ascii"), dtype=np.uint8)[:n] for x in (q, g))
            a, b = a[b != 45], b[b != 45]
            comparable = known[a] & known[b]
            seen, expected = np.where(comparable, a, 46).astype(np.uint8), np.where(comparable, b, 46).astype(np.uint8)
            at = np.flatnonzero(comparable & (a != b))
            events = [{"position": int(start + i), "ref": chr(b[i]), "alt": chr(a[i])} for i in at]
            rows.append((seen.tobytes().decode(), expected.tobytes().decode(), events, int(comparable.sum())))
        return pd.DataFrame(rows, columns=["bases", "expected", "events", "aligned"])

    return view.asNondeterministic()


def base_at(position: Column, letters: str = "bases") -> Column:
    """Observed letter at a germline position, ``.`` where nothing is comparable."""
    offset = position - F.col("first") + 1
    inside = (offset >= 1) & (offset <= F.length(letters))
    return F.when(inside, F.substring(F.col(letters), offset.cast("int"), F.lit(1))).otherwise(".")


def discovery_units(observed: DataFrame, options: MissingOptions) -> DataFrame:
    """The least mutated eligible member of every lineage."""
    fit = observed.filter((F.col("aligned") >= options.min_aligned) & (F.col("rate") <= options.max_shm))
    best = fit.groupBy("lineage_id").agg(
        F.min_by(
            F.struct("ordinal", "v_call", "j_call", "subject_id", "cdr3", "first", "bases", "events", "aligned", "rate"),
            F.struct(F.col("rate"), -F.col("aligned"), F.col("ordinal")),
        ).alias("u")
    )
    return best.select("lineage_id", "u.*")


def position_coverage(units: DataFrame) -> DataFrame:
    """Lineages comparable at each germline position, from interval ends.

    A lineage contributes +1 where a comparable run opens and -1 after it closes, so
    the shuffle carries a few rows per lineage; the running sum is over the positions
    of one gene.
    """
    n = F.length("bases")

    def letter(i: Column) -> Column:
        return F.substring(F.col("bases"), i, F.lit(1))

    opens = F.filter(F.sequence(F.lit(1), n), lambda i: (letter(i) != ".") & ((i == 1) | (letter(i - 1) == ".")))
    closes = F.filter(F.sequence(F.lit(1), n), lambda i: (letter(i) != ".") & ((i == n) | (letter(i + 1) == ".")))
    ends = F.concat(
        F.transform(opens, lambda i: F.struct((i + F.col("first") - 1).alias("position"), F.lit(1).alias("delta"))),
        F.transform(closes, lambda i: F.struct((i + F.col("first")).alias("position"), F.lit(-1).alias("delta"))),
    )
    deltas = units.filter(n > 0).select("v_call", F.explode(ends).alias("e")).groupBy("v_call", "e.position").agg(F.sum("e.delta").alias("delta"))
    per_gene = deltas.groupBy("v_call").agg(F.array_sort(F.collect_list(F.struct("position", "delta"))).alias("steps"))
    # runs between consecutive steps: at most two per position of the gene
    run = F.transform(
        F.sequence(F.lit(1), F.size("steps")),
        lambda k: F.struct(
            F.element_at("steps", k)["position"].alias("from_position"),
            F.coalesce(F.try_element_at("steps", k + 1)["position"] - 1, F.element_at("steps", k)["position"]).alias("to_position"),
            F.aggregate(F.slice("steps", 1, k), F.lit(0).cast("bigint"), lambda s, x: s + x["delta"]).alias("coverage"),
        ),
    )
    return per_gene.select("v_call", F.explode(run).alias("r")).select("v_call", "r.*").filter("coverage > 0")


def site_support(units: DataFrame, reference: DataFrame) -> DataFrame:
    """Support, coverage and fraction of every substitution that fits its parent."""
    seqs = reference.select(F.col("name").alias("v_call"), F.col("sequence").alias("parent"))
    joined = units.join(seqs, "v_call")
    changes = joined.select("v_call", "parent", "aligned", F.explode("events").alias("e")).filter(
        F.substring(F.col("parent"), F.col("e.position"), F.lit(1)) == F.col("e.ref")
    )
    support = changes.groupBy("v_call", "e.position", "e.ref", "e.alt").agg(
        F.count(F.lit(1)).alias("support"), F.sum(1 / F.greatest(F.lit(1), F.col("aligned"))).alias("own_rate"), F.first("parent").alias("parent")
    )
    runs = position_coverage(units).withColumnRenamed("v_call", "_v")
    inside = (F.col("v_call") == F.col("_v")) & F.col("position").between(F.col("from_position"), F.col("to_position"))
    # both sides are bounded per gene: substitutions by 3 x length, runs by 2 x length
    return support.join(runs, inside, "left").select(
        "v_call", "position", "ref", "alt", "support", "own_rate", "parent", F.coalesce("coverage", F.lit(0)).cast("bigint").alias("coverage")
    ).withColumn("fraction", F.col("support") / F.greatest(F.lit(1), F.col("coverage")))


def passing_events(units: DataFrame, reference: DataFrame, options: MissingOptions) -> DataFrame:
    """Substitutions frequent and improbable enough to seed a candidate, ranked per V."""
    genes = units.groupBy("v_call").agg(F.count(F.lit(1)).alias("items"), F.sum("rate").alias("rates")).filter(F.col("items") >= options.min_covered)
    sites = site_support(units, reference).join(genes, "v_call")
    background = F.greatest(F.lit(0.0), (F.col("rates") - F.col("own_rate")) / F.col("items"))
    sites = sites.withColumn("hotspot", hotspot("parent", F.col("position")))
    sites = sites.filter(
        (F.col("support") >= options.min_units) & (F.col("coverage") >= options.min_covered) & (F.col("fraction") >= options.min_fraction)
    )
    sites = sites.withColumn(
        "p", binomial_survival(F.col("support").cast("double"), F.col("coverage").cast("double"), mutation_null_probability(background, F.col("hotspot")))
    ).filter(F.col("p") <= options.max_p)
    order = F.struct("p", -F.col("fraction"), -F.col("support"), "position", "alt", "ref", "support", "coverage", "fraction", "hotspot")
    # at most three substitutions per position of one gene
    ranked = sites.groupBy("v_call").agg(F.array_sort(F.collect_list(order)).alias("all"), F.first("parent").alias("parent"))
    return ranked.select("v_call", "parent", F.posexplode("all").alias("rank", "e")).select(
        "v_call", "parent", "rank", *[F.col(f"e.{c}").alias(c) for c in ("position", "ref", "alt", "support", "coverage", "fraction", "p", "hotspot")]
    )


def _event_list(events: DataFrame) -> DataFrame:
    return events.groupBy("v_call").agg(
        F.array_sort(F.collect_list(F.struct("rank", "position", "ref", "alt", "hotspot"))).alias("listed"), F.first("parent").alias("parent")
    )


def unit_patterns(units: DataFrame, events: DataFrame) -> DataFrame:
    """Per lineage: the ranks of the passing events it supports and covers."""
    joined = units.join(_event_list(events).select("v_call", "listed"), "v_call")

    def ranks(test) -> Column:
        return F.transform(F.filter("listed", test), lambda e: e["rank"])

    return joined.withColumn("supports", ranks(lambda e: F.exists("events", lambda m: (m["position"] == e["position"]) & (m["ref"] == e["ref"]) & (m["alt"] == e["alt"])))).withColumn(
        "covers", ranks(lambda e: base_at(e["position"]) != ".")
    )


def _holds_all(have: str, wanted: str) -> Column:
    return F.size(F.array_except(wanted, have)) == 0


def linked_haplotypes(patterns: DataFrame, events: DataFrame, options: MissingOptions) -> DataFrame:
    """Greedy linkage from every seed event: ``(v_call, chosen)``, distinct sets.

    Candidates are offered in rank order. Each offer is one aggregate over patterns
    for all V alleles and seeds together; the number of offers is the largest number of
    passing events of one allele, not a function of the data size.
    """
    counted = cut(patterns.groupBy("v_call", "supports", "covers").agg(F.count(F.lit(1)).alias("n")))
    state = cut(events.select("v_call", F.col("rank").alias("seed"), F.array("rank").alias("chosen")))
    last = events.agg(F.max("rank")).first()[0]
    for rank in range((last if last is not None else -1) + 1):
        has = events.filter(F.col("rank") == rank).select("v_call")
        room = F.lit(True) if options.max_snps is None else F.size("chosen") < options.max_snps
        offered = state.join(has, "v_call", "left_semi").filter(room & ~F.array_contains("chosen", rank))
        joined = offered.join(counted, "v_call")
        supported, covered = F.array_contains("supports", rank), F.array_contains("covers", rank)
        whole = _holds_all("supports", "chosen")
        sums = joined.groupBy("v_call", "seed").agg(
            F.sum(F.when(whole & covered, F.col("n")).otherwise(0)).alias("eligible"),
            F.sum(F.when(whole & covered & supported, F.col("n")).otherwise(0)).alias("both"),
            F.sum(F.when(supported & _holds_all("covers", "chosen"), F.col("n")).otherwise(0)).alias("other"),
        )
        good = sums.filter(
            (F.col("both") >= options.min_units)
            & (F.col("both") / F.greatest(F.lit(1), F.col("eligible")) >= options.min_linked)
            & (F.col("both") / F.greatest(F.lit(1), F.col("other")) >= options.min_linked)
        ).select("v_call", "seed", F.lit(rank).alias("added"))
        state = cut(
            state.join(good, ["v_call", "seed"], "left").select(
                "v_call", "seed", F.when(F.col("added").isNotNull(), F.concat("chosen", F.array("added"))).otherwise(F.col("chosen")).alias("chosen")
            )
        )
    return state.select("v_call", F.array_sort("chosen").alias("chosen")).distinct()


def _diversity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct J calls, junction lengths, CDR3s and subjects per group."""
    filled = F.col("cdr3") != ""
    return rows.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("j_call") != "", F.col("j_call"))).alias("distinct_j_calls"),
        F.countDistinct(F.when(filled, F.length("cdr3"))).alias("distinct_junction_lengths"),
        F.countDistinct(F.when(filled, F.col("cdr3"))).alias("distinct_cdr3s"),
        F.countDistinct("subject_id").alias("distinct_subjects"),
    )


def _diverse_enough(options: MissingOptions) -> Column:
    return (
        (F.col("distinct_j_calls") >= options.min_j_calls)
        & (F.col("distinct_junction_lengths") >= options.min_junction_lengths)
        & (F.col("distinct_cdr3s") >= options.min_cdr3s)
    )


def _maximal(candidates: DataFrame, supporters: DataFrame, support: str, options: MissingOptions) -> DataFrame:
    """Drop a candidate contained in a longer one that most of its lineages share."""
    a = candidates.select("v_call", F.col("proposal").alias("small"), F.col("chosen").alias("small_set"), F.col(support).alias("size"))
    b = candidates.select("v_call", F.col("proposal").alias("large"), F.col("chosen").alias("large_set"))
    nested = a.join(b, "v_call").filter((F.size("large_set") > F.size("small_set")) & _holds_all("large_set", "small_set"))
    s1 = supporters.select(F.col("proposal").alias("small"), "lineage_id")
    s2 = supporters.select(F.col("proposal").alias("large"), "lineage_id")
    shared = nested.join(s1, "small").join(s2, ["large", "lineage_id"]).groupBy("small", "large", "size").agg(F.count(F.lit(1)).alias("n"))
    covered = shared.filter(F.col("n") / F.greatest(F.lit(1), F.col("size")) >= options.min_linked).select(F.col("small").alias("proposal")).distinct()
    return candidates.join(covered, "proposal", "left_anti")


def _substituted(parent: Column, picked: Column) -> Column:
    """The parent with each picked substitution applied."""
    return F.aggregate(
        picked, parent,
        lambda s, e: F.concat(F.substring(s, F.lit(1), e["position"] - 1), e["alt"], F.substring(s, e["position"] + 1, F.length(s))),
    )


def proposals(units: DataFrame, patterns: DataFrame, events: DataFrame, reference: DataFrame, options: MissingOptions) -> DataFrame:
    """Pass one: linked haplotypes that look like an unlisted allele."""
    sets = linked_haplotypes(patterns, events, options)
    listed = _event_list(events)
    picked = F.filter("listed", lambda e: F.array_contains("chosen", e["rank"]))
    base = cut(
        sets.join(listed, "v_call")
        .withColumn("picked", F.array_sort(F.transform(picked, lambda e: F.struct(e["position"].alias("position"), e["ref"].alias("ref"), e["alt"].alias("alt"), e["hotspot"].alias("hotspot")))))
        .withColumn("sequence", _substituted(F.col("parent"), F.col("picked")))
        .withColumn("proposal", F.concat_ws("|", "v_call", F.array_join(F.transform("picked", lambda e: F.concat(e["position"].cast("string"), F.lit(":"), e["ref"], F.lit(">"), e["alt"])), "|")))
        .drop("listed")
        .join(reference.select("sequence").distinct(), "sequence", "left_anti")
    )
    joined = base.select("proposal", "v_call", "chosen").join(patterns, "v_call")
    hits = F.size(F.array_intersect("chosen", "supports"))
    supports = F.size(F.array_except("chosen", "supports")) == 0
    stats = joined.groupBy("proposal").agg(
        F.count_if(supports).alias("supporting"),
        F.count_if(_holds_all("covers", "chosen")).alias("covered"),
        F.avg(F.greatest(F.lit(0), F.size("events") - hits) / F.greatest(F.lit(1), F.col("aligned"))).alias("background"),
    )
    supporters = joined.filter(supports).select("proposal", "lineage_id", "j_call", "cdr3", "subject_id")
    null = F.aggregate("picked", F.lit(1.0), lambda s, e: s * mutation_null_probability(F.col("background"), e["hotspot"]))
    scored = base.join(stats, "proposal").join(_diversity(supporters, ["proposal"]), "proposal").withColumn("null_probability", null)
    scored = scored.withColumn("p", binomial_survival(F.col("supporting").cast("double"), F.col("covered").cast("double"), F.col("null_probability")))
    kept = scored.filter(
        (F.col("supporting") >= options.min_units) & (F.col("covered") >= options.min_covered)
        & (F.col("supporting") / F.greatest(F.lit(1), F.col("covered")) >= options.min_fraction)
        & (F.col("p") <= options.max_p) & _diverse_enough(options)
    )
    kept = cut(kept.select("proposal", "v_call", "chosen", "picked", "sequence", "background", "null_probability", "supporting"))
    return _maximal(kept, supporters, "supporting", options)


def missing_alleles(table: DataFrame, reference: DataFrame, options: MissingOptions | None = None) -> DataFrame:
    """Candidate alleles that pass both passes.

    ``table`` is the rearrangement table with ``lineage_id``; ``reference`` has
    ``name`` and ungapped ``sequence``.
    """
    options = options or MissingOptions()
    reference = reference.select("name", normalize_nt("sequence").alias("sequence"))
    observed = observations(table)
    units = cut(discovery_units(observed, options))
    events = cut(passing_events(units, reference, options))
    patterns = cut(unit_patterns(units, events))
    found = cut(proposals(units, patterns, events, reference, options))

    # pass two: every member of a lineage whose discovery V has a proposal
    of_unit = patterns.select("lineage_id", F.col("v_call").alias("unit_v")).join(found.select(F.col("v_call").alias("unit_v")).distinct(), "unit_v", "left_semi")
    members = observed.join(of_unit, "lineage_id")
    mixed = members.filter(F.col("v_call") != F.col("unit_v")).select("lineage_id").distinct().withColumn("mixed", F.lit(True))
    same = members.filter(F.col("v_call") == F.col("unit_v")).join(found.select(F.col("v_call").alias("unit_v"), "proposal", "picked"), "unit_v")
    states = F.transform(
        "picked",
        lambda e: F.struct(
            (base_at(e["position"]) != ".").alias("seen"), (base_at(e["position"], "expected") == e["ref"]).alias("fits"),
            (base_at(e["position"]) == e["ref"]).alias("reference"), (base_at(e["position"]) == e["alt"]).alias("alternate"),
        ),
    )
    judged = same.withColumn("s", states).select(
        "lineage_id", "proposal",
        F.forall("s", lambda x: x["seen"] & x["fits"]).alias("covered"),
        F.forall("s", lambda x: x["seen"] & x["fits"] & x["alternate"]).alias("alternate"),
        F.exists("s", lambda x: x["seen"] & x["fits"] & x["reference"]).alias("reference"),
        F.exists("s", lambda x: x["seen"] & (~x["fits"] | (~x["reference"] & ~x["alternate"]))).alias("conflict"),
    )
    flags = judged.groupBy("lineage_id", "proposal").agg(*[F.bool_or(c).alias(c) for c in ("covered", "alternate", "reference", "conflict")])
    flags = cut(flags.join(mixed, "lineage_id", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))))
    supporting = flags.filter(F.col("alternate") & ~F.col("reference") & ~F.col("conflict") & ~F.col("mixed")).select("lineage_id", "proposal")
    counts = flags.groupBy("proposal").agg(
        F.count_if(F.col("covered") & ~F.col("mixed")).alias("covered_units"),
        F.count_if(F.col("alternate") & F.col("reference")).alias("reference_units"),
        F.count_if(F.col("conflict") & ~F.col("mixed")).alias("conflicting_units"),
    )
    seen = supporting.join(patterns.select("lineage_id", "events", "j_call", "cdr3", "subject_id"), "lineage_id").join(found.select("proposal", "picked"), "proposal")
    extra = F.filter("events", lambda m: ~F.exists("picked", lambda e: (e["position"] == m["position"]) & (e["ref"] == m["ref"]) & (e["alt"] == m["alt"])))
    seen = cut(seen.withColumn("near", (F.size(extra) <= 2).cast("int")))
    breadth = seen.groupBy("proposal").agg(F.count(F.lit(1)).alias("independent_units"), F.sum("near").alias("near_germline_units"))
    scored = found.join(counts, "proposal").join(breadth, "proposal").join(_diversity(seen, ["proposal"]), "proposal")
    scored = scored.withColumn(
        "p", binomial_survival(F.col("independent_units").cast("double"), F.col("covered_units").cast("double"), F.col("null_probability"))
    )
    covered = F.greatest(F.lit(1), F.col("covered_units"))
    scored = scored.withColumn("allele_fraction", F.col("independent_units") / covered).withColumn("other_alternate_fraction", F.col("conflicting_units") / covered)
    kept = cut(
        scored.filter(
            (F.col("independent_units") >= options.min_units) & (F.col("covered_units") >= options.min_covered)
            & (F.col("allele_fraction") >= options.min_fraction) & (F.col("other_alternate_fraction") <= options.max_other_alternate)
            & (F.col("p") <= options.max_p) & _diverse_enough(options) & (F.col("near_germline_units") >= options.min_near_germline)
        )
    )
    final = _maximal(kept, supporting, "independent_units", options)
    substitutions = F.array_join(F.transform("picked", lambda e: F.concat(e["ref"], e["position"].cast("string"), e["alt"])), "+")
    return final.select(
        F.regexp_replace("proposal", r"[^A-Za-z0-9_.:>|*-]", "_").alias("candidate_id"), F.col("v_call").alias("parent_allele"),
        substitutions.alias("substitutions"), "independent_units", "covered_units", "allele_fraction", "p",
        "distinct_j_calls", "distinct_junction_lengths", "distinct_cdr3s", "distinct_subjects", "near_germline_units",
        "reference_units", "conflicting_units", "other_alternate_fraction", F.col("background").alias("mean_background_shm"), "sequence",
    )


def needs_complete_reference(candidates: DataFrame) -> DataFrame:
    """One row saying whether the findings call for a better reference set."""
    wide = F.col("independent_units") > 50
    return candidates.agg(((F.count_if(wide) > 0) | (F.count_if(~wide) > 5)).alias("needs_complete_reference"))


def augmented_reference(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reference plus chosen candidates; a candidate inherits its parent's metadata."""
    extra = [c for c in reference.columns if c not in ("name", "sequence")]
    parent = reference.select(F.col("name").alias("parent_allele"), *extra)
    added = candidates.join(parent, "parent_allele", "left").select(F.col("candidate_id").alias("name"), "sequence", *extra)
    clash = reference.select("name")
    return reference.select("name", "sequence", *extra).unionByName(added.join(clash, "name", "left_anti"))
