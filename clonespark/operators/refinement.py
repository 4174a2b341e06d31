"""Repertoire-level refinement of ambiguous allele calls.

Each read spreads its evidence over the alleles it may come from; a Dirichlet usage
model per (study scope, locus, segment) then sharpens the calls. The model's state is
a row per pool and allele. Reads with equal evidence are one weighted row, and every
update is a sum over blocks of them (``allele_models``), so a pool holding most of the
reads is spread over the cluster like any other. Beside the Dirichlet model there is one that
gives absent alleles a usage of exactly zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import let
from ..functions.sequences import calls, infer_locus, multiplicity, normalize_nt, number, text
from ..functions.statistics import neighbour_odds
from ..session import cut
from . import allele_models
from .simjoin import edit_pairs, hamming_pairs
from .study import scope_value


@dataclass(frozen=True)
class RefinementOptions:
    segment: str = "V"
    scope: str = "subject"
    alpha: float = 0.1
    baseline_odds: float = 0.01
    shm_sensitivity: float = 1.0
    max_odds: float = 0.25
    max_shm: float = 0.3
    radius: int = 2
    temperature: float = 2.0
    unscored_weight: float = 0.25
    weighting: str = "unique"  # or "abundance"
    max_iterations: int = 10_000
    tolerance: float = 1e-6
    model: str = "dirichlet"  # or "active-set"
    active_fraction: float = 0.15
    inclusion_threshold: float = 0.5
    tail_shape: float = 0.35
    frequency_floor: float = 1e-6
    quadrature_points: int = 12
    max_sweeps: int = 8
    at_limit: str = "raise"  # or "flag": rows of pools that have not converged say so


def allele_nodes(reference: DataFrame) -> DataFrame:
    """Alleles with one sequence per locus are one node: ``node, locus, sequence, names``."""
    named = reference.select(F.trim(text("name")).alias("name"), normalize_nt("sequence").alias("sequence")).filter("name <> '' AND sequence <> ''")
    keyed = named.withColumn("locus", infer_locus("name"))
    return keyed.groupBy("locus", "sequence").agg(F.array_sort(F.collect_set("name")).alias("names")).select(
        F.element_at("names", 1).alias("node"), "locus", "sequence", "names"
    )


def allele_edges(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Near alleles of one locus, both directions: ``node, neighbour, distance, substitution_only``.

    Equal lengths meet on exact blocks, different lengths on shifted segments.
    """
    if radius < 1:
        return nodes.select("node", F.col("node").alias("neighbour"), F.lit(0).alias("distance"), F.lit(True).alias("substitution_only")).limit(0)
    rows = cut(nodes.select(F.xxhash64("node").alias("id"), F.col("locus").alias("part"), F.col("sequence").alias("seq"), "node"))
    same = hamming_pairs(rows.select("id", "part", "seq", F.lit(radius).alias("lim"))).withColumn("substitution_only", F.lit(True))
    base = rows.select("id", "part", "seq")
    other = edit_pairs(base, base, limit=radius).filter("left_id < right_id")
    length = rows.select("id", F.length("seq").alias("n"))
    uneven = (
        other.join(length.select(F.col("id").alias("left_id"), F.col("n").alias("a")), "left_id")
        .join(length.select(F.col("id").alias("right_id"), F.col("n").alias("b")), "right_id")
        .filter("a <> b")
        .select("left_id", "right_id", "distance", F.lit(False).alias("substitution_only"))
    )
    both = same.unionByName(uneven)
    both = both.unionByName(both.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "distance", "substitution_only"))
    a = rows.select(F.col("id").alias("left_id"), "node")
    b = rows.select(F.col("id").alias("right_id"), F.col("node").alias("neighbour"))
    return both.join(a, "left_id").join(b, "right_id").select("node", "neighbour", "distance", "substitution_only")


def _fraction(value: Column) -> Column:
    return let(value, lambda v: let(F.when(v > 1, v / 100).otherwise(v), lambda x: F.when((x >= 0) & (x <= 1), x)))


def alternatives(column: str) -> Column:
    """Decode ``call|score|identity|…`` lists into ``array<struct<call, score, identity>>``."""
    parsed = F.transform(F.split(text(column), ";"), lambda e: F.split(e, r"\|"))

    def field(parts: Column, i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    out = F.transform(
        parsed,
        lambda p: F.struct(
            F.trim(field(p, 0)).alias("call"),
            # an empty but present score field reads as zero, an absent one as unknown
            F.when(F.size(p) > 1, F.when(F.trim(field(p, 1)) == "", F.lit(0.0)).otherwise(number(field(p, 1)))).alias("score"),
            _fraction(number(field(p, 2))).alias("identity"),
        ),
    )
    return F.filter(out, lambda a: a["call"] != "")


def refinement_rows(table: DataFrame, options: RefinementOptions) -> DataFrame:
    """Input of the evidence model: calls, alternatives, read mutation rate and weight."""
    s = options.segment.lower()
    names = table.columns
    # each list is parsed once, in a column of its own
    parsed = {p: f"{p} alternatives parsed" for p in ("v", s) if f"{p}_alternatives" in names}
    table = table.withColumns({column: alternatives(f"{p}_alternatives") for p, column in parsed.items()}) if parsed else table

    def best_identity(prefix: str) -> Column:
        direct = _fraction(number(f"{prefix}_identity")) if f"{prefix}_identity" in names else F.lit(None).cast("double")
        if f"{prefix}_alternatives" not in names:
            return direct
        listed = F.array_max(F.transform(parsed[prefix], lambda a: a["identity"]))
        return F.greatest(direct, listed)

    identity = F.coalesce(*[best_identity(p) for p in dict.fromkeys(("v", s))])
    score = number(f"{s}_score") if f"{s}_score" in names else F.lit(None).cast("double")
    listed = F.col(parsed[s]) if s in parsed else F.array().cast("array<struct<call:string,score:double,identity:double>>")
    return table.select(
        "ordinal",
        F.concat_ws("\t", scope_value(options.scope), text("locus")).alias("pool"),
        text("locus").alias("locus"),
        F.array_distinct(calls(f"{s}_call")).alias("calls"),
        listed.alias("alternatives"),
        score.alias("score"),
        F.greatest(F.lit(0.0), 1 - identity).alias("shm"),
        multiplicity("duplicate_count").alias("abundance"),
    )


def evidence(rows: DataFrame, nodes: DataFrame, edges: DataFrame, options: RefinementOptions) -> DataFrame:
    """Normalised evidence ``(ordinal, pool, node, weight, abundance)``.

    Reported calls weigh one, alternatives decay with their score gap, and reference
    neighbours of either receive ``odds ** distance`` of their source.
    """
    relative = lambda a: F.when(
        a["score"].isNotNull() & F.col("score").isNotNull(),
        F.least(F.lit(1.0), F.exp((a["score"] - F.col("score")) / F.lit(max(1e-6, options.temperature)))),
    ).otherwise(F.lit(options.unscored_weight))
    listed = F.concat(
        F.transform("calls", lambda c: F.struct(c.alias("call"), F.lit(1.0).alias("weight"))),
        F.transform("alternatives", lambda a: F.struct(a["call"].alias("call"), relative(a).alias("weight"))),
    )
    odds = neighbour_odds(F.col("shm"), options.baseline_odds, options.shm_sensitivity, options.max_shm, options.max_odds)
    base = max(0.0, min(options.max_odds, options.baseline_odds))
    given = rows.select("ordinal", "pool", "abundance", odds.alias("odds"), listed.alias("listed")).crossJoin(F.broadcast(_reach(nodes, edges, options.radius)))
    unknown = F.array().cast("array<struct<node:string,near:array<struct<node:string,distance:int,substitution_only:boolean>>>>")
    named = F.flatten(F.transform("listed", lambda e: F.transform(
        F.coalesce(F.try_element_at("reach", e["call"]), unknown), lambda n: F.struct(n["node"].alias("node"), e["weight"].alias("weight"), n["near"].alias("near"))
    )))

    def first_of_node(found: Column) -> Column:
        """One weight per node: a reported call, else the first alternative naming it."""
        return let(F.transform(found, lambda d: d["node"]), lambda own: F.filter(found, lambda d, i: F.array_position(own, d["node"]) == i + 1))

    def spread(direct: Column) -> Column:
        leaked = F.flatten(F.transform(direct, lambda d: F.transform(d["near"], lambda n: F.struct(
            n["node"].alias("node"), (d["weight"] * F.pow(F.when(n["substitution_only"], F.col("odds")).otherwise(F.lit(base)), n["distance"])).alias("weight")
        ))))
        return F.concat(F.transform(direct, lambda d: F.struct(d["node"].alias("node"), d["weight"].alias("weight"))), leaked)

    def strongest(entries: Column) -> Column:
        own = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["node"])))
        best = F.transform(own, lambda n: F.struct(n.alias("node"), F.array_max(F.transform(F.filter(entries, lambda e: e["node"] == n), lambda e: e["weight"])).alias("weight")))
        return F.filter(best, lambda e: e["weight"] > 0)

    def shares(entries: Column) -> Column:
        total = F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["weight"])
        return let(total, lambda t: F.transform(entries, lambda e: F.struct(e["node"].alias("node"), (e["weight"] / t).alias("weight"))))

    packed = let(let(let(let(named, first_of_node), spread), strongest), shares)
    # written once: the filter would be moved below and work the entries out a second time
    return cut(given.select(
        "ordinal", "pool", (F.col("abundance").cast("double") if options.weighting == "abundance" else F.lit(1.0)).alias("read_weight"), packed.alias("entries")
    )).filter(F.size("entries") > 0)


def _reach(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """One row, as large as the reference: ``reach``, from a call to the nodes it names and their neighbours.

    Every read looks up its calls in it, so reads are neither shuffled nor dealt by call.
    """
    near = edges.filter(F.col("distance") <= radius).groupBy("node").agg(
        F.collect_list(F.struct(F.col("neighbour").alias("node"), F.col("distance").cast("int").alias("distance"), "substitution_only")).alias("near")
    )
    named = nodes.select("node", F.explode("names").alias("call")).join(near, "node", "left")
    none = F.array().cast("array<struct<node:string,distance:int,substitution_only:boolean>>")
    by_call = named.groupBy("call").agg(F.collect_list(F.struct("node", F.coalesce("near", none).alias("near"))).alias("named"))
    return by_call.agg(F.map_from_entries(F.collect_list(F.struct("call", "named"))).alias("reach"))


def _posterior(entries: str = "entries", state: str = "expected") -> Column:
    """Posterior over a row's own alleles given the pool's expected log usage; alleles without one have no part."""
    scored = F.transform(entries, lambda e: F.struct(e["node"].alias("node"), (F.log(e["weight"]) + F.element_at(state, e["node"])).alias("x")))
    scored = F.filter(scored, lambda e: e["x"].isNotNull())

    def raised(found: Column) -> Column:
        return let(F.array_max(F.transform(found, lambda e: e["x"])), lambda peak: F.transform(found, lambda e: F.struct(e["node"].alias("node"), F.exp(e["x"] - peak).alias("x"))))

    def shares(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda t, e: t + e["x"])
        return let(total, lambda t: F.transform(found, lambda e: F.struct(e["node"].alias("node"), (e["x"] / t).alias("probability"))))

    # every step is worked out once a read, not once for every allele of the step behind it
    return let(let(scored, raised), shares)


def fit_usage(rows: DataFrame, nodes: DataFrame, options: RefinementOptions) -> DataFrame:
    """Usage of every allele of every pool that some read supports.

    ``pool, node, expected`` (log usage in the posterior of a read; null if the allele is not active), ``posterior_mean, posterior_sd,
    expected_assignments, local_evidence, inclusion, active, iterations, converged, n_rows, effective_rows,
    database_nodes, silent_nodes``. Alleles of the locus that no read supports stay implicit. A pool that does not
    converge within ``max_iterations`` updates (an active set: ``max_sweeps`` sweeps) is an error, or with
    ``at_limit="flag"`` has ``converged`` false.
    """
    packed = allele_models.pack(rows, nodes)
    fitted = cut(allele_models.fit_pools(packed, options))
    if options.at_limit == "raise" and not fitted.filter("NOT converged").isEmpty():
        raise RuntimeError(f"A pool has not converged after {options.max_iterations} updates or {options.max_sweeps} sweeps; raise the limit or the tolerance.")
    pools = packed.pools.select(
        "pool", "n_rows", F.col("database").alias("database_nodes"), F.greatest(F.lit(0), F.col("database") - F.size("names")).alias("silent_nodes")
    )
    return fitted.join(pools, "pool")


@dataclass(frozen=True)
class Refinement:
    """A fit and what it was made from: evidence ``rows``, ``nodes``, ``usage`` (see ``fit_usage``) and ``calls`` per record."""

    options: RefinementOptions
    rows: DataFrame
    nodes: DataFrame
    usage: DataFrame
    calls: DataFrame


def refine(table: DataFrame, reference: DataFrame, options: RefinementOptions | None = None) -> Refinement:
    options = options or RefinementOptions()
    nodes = cut(allele_nodes(reference))
    edges = cut(allele_edges(nodes, options.radius))
    rows = evidence(refinement_rows(table, options), nodes, edges, options)
    usage = fit_usage(rows, nodes, options)
    return Refinement(options, rows, nodes, usage, _calls(_scored(rows, usage), nodes))


def _scored(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Evidence rows with their posterior, and what is known of their pool."""
    known = F.map_from_entries(F.filter(F.collect_list(F.struct("node", "expected")), lambda e: e["expected"].isNotNull()))
    maps = usage.groupBy("pool").agg(known.alias("expected"), F.max("iterations").alias("iterations"), F.every("converged").alias("converged"))
    # reads of a pool stay where they are as long as the usages are small: pools are few and large
    few = usage.count() * allele_models.STATE_BYTES <= allele_models.BROADCAST
    return rows.join(F.broadcast(maps) if few else maps, "pool").withColumn("posterior", _posterior()).drop("expected")


def _leading(column: str, value: str) -> Column:
    return F.array_min(F.transform(column, lambda e: F.struct((-e[value]).alias("x"), e["node"].alias("node"))))


def _decided(scored: DataFrame) -> DataFrame:
    best, local = _leading("posterior", "probability"), _leading("entries", "weight")
    entropy = F.aggregate("posterior", F.lit(0.0), lambda s, e: s - F.when(e["probability"] > 0, e["probability"] * F.log(e["probability"])).otherwise(0.0))
    none = F.size("posterior") == 0
    return scored.withColumns({
        "map_node": F.when(none, local["node"]).otherwise(best["node"]), "map_probability": F.when(none, F.lit(1.0)).otherwise(-best["x"]),
        "entropy": entropy, "local_top": local["node"], "local_probability": -local["x"],
    })


def _calls(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    labels = nodes.select(F.col("node").alias("map_node"), F.array_join("names", ",").alias("map_call"))
    return _decided(scored).select(
        "ordinal", "pool", "map_node", "map_probability", "entropy", "local_top", "local_probability", "iterations", "converged", "read_weight"
    ).join(labels, "map_node")


def refine_calls(table: DataFrame, reference: DataFrame, options: RefinementOptions | None = None) -> DataFrame:
    """Posterior call per record: ``ordinal, pool, map_node, map_call, map_probability, entropy, local_top, local_probability, iterations, converged, read_weight``.

    ``iterations`` is how many updates the pool of the record took. A record none of whose alleles is active keeps
    its best local allele with probability one.
    """
    return refine(table, reference, options).calls


def passes_policy(probability: Column, policy: str, minimum: float) -> Column:
    return F.lit(True) if policy == "best" else probability >= max(0.0, min(1.0, minimum))


def posterior_rows(table: DataFrame, fit: Refinement, policy: str = "confidence", minimum: float = 0.8) -> DataFrame:
    """One row per record and candidate allele: where the candidate comes from, its evidence and its posterior.

    ``source`` is ``reported``, ``retained_alternative`` or ``reference_neighbour``; candidates that are not active have
    a posterior of zero. Records of which no candidate is active have no rows.
    """
    given = refinement_rows(table, fit.options)
    names = fit.nodes.select("node", F.explode("names").alias("call"))
    named = given.select("ordinal", F.explode(F.concat(
        F.transform("calls", lambda c: F.struct(c.alias("call"), F.lit(0).alias("kind"))), F.transform("alternatives", lambda a: F.struct(a["call"].alias("call"), F.lit(1).alias("kind")))
    )).alias("e")).select("ordinal", "e.*").join(names, "call").groupBy("ordinal", "node").agg(F.min("kind").alias("kind"))
    decided = _decided(_scored(fit.rows, fit.usage)).filter(F.size("posterior") > 0)
    posterior = F.map_from_entries("posterior")
    listed = decided.select("ordinal", "pool", "map_node", "map_probability", "entropy", posterior.alias("p"), F.explode("entries").alias("e")).select(
        "ordinal", "pool", F.col("e.node").alias("node"), F.col("e.weight").alias("local_evidence"),
        F.coalesce(F.element_at("p", F.col("e.node")), F.lit(0.0)).alias("repertoire_posterior"),
        (F.col("map_node") == F.col("e.node")).alias("is_map"), "map_probability", "entropy",
    )
    pool = fit.usage.select("pool", "node", F.col("posterior_mean").alias("pool_posterior_mean"), F.col("active").alias("pool_active"), F.col("inclusion").alias("pool_inclusion"))
    kind = F.element_at(F.array(F.lit("reported"), F.lit("retained_alternative"), F.lit("reference_neighbour")), F.coalesce("kind", F.lit(2)) + 1)
    return (
        listed.join(pool, ["pool", "node"], "left").join(named, ["ordinal", "node"], "left")
        .withColumn("source", kind).withColumn("selected", F.col("is_map") & passes_policy(F.col("map_probability"), policy, minimum))
        .join(fit.nodes.select("node", F.array_join("names", ",").alias("candidate_call")), "node").drop("kind")
    )


def pool_summary(fit: Refinement) -> DataFrame:
    """The alleles of each pool in posterior order (``rank``): active ones by mean, inclusion (both to nine digits) and names, then the others."""
    labelled = fit.usage.join(fit.nodes.select("node", F.array_join("names", ",").alias("labels")), "node")
    of_pool = Window.partitionBy("pool")
    order = of_pool.orderBy(F.desc("active"), F.desc(F.round("posterior_mean", 9)), F.desc(F.round(F.coalesce("inclusion", F.lit(0.0)), 9)), "labels")
    return labelled.withColumn("rank", F.row_number().over(order)).withColumn("active_alleles", F.sum(F.col("active").cast("int")).over(of_pool)).drop("expected")


def apply_refinement(table: DataFrame, refined: DataFrame, segment: str = "V", policy: str = "confidence", minimum: float = 0.8) -> DataFrame:
    """Overlay posterior calls; the original call is kept beside the chosen one."""
    column = f"{segment.lower()}_call"
    chosen = refined.filter(passes_policy(F.col("map_probability"), policy, minimum)).select("ordinal", F.col("map_call").alias("_refined"))
    joined = table.join(chosen, "ordinal", "left").withColumn(f"original_{column}", F.col(column))
    return joined.withColumn(column, F.coalesce("_refined", column)).drop("_refined")


def assignment_shift(refined: DataFrame, policy: str = "confidence", minimum: float = 0.8) -> DataFrame:
    """Weight of the records on each allele of a pool before and after refinement: ``pool, node, before, after, delta, vanishes, appears``.

    A record whose posterior call the policy does not accept stays with its local call.
    """
    applied = F.when(passes_policy(F.col("map_probability"), policy, minimum), F.col("map_node")).otherwise(F.col("local_top"))
    sides = F.array(
        F.struct(F.col("local_top").alias("node"), F.col("read_weight").alias("before"), F.lit(0.0).alias("after")),
        F.struct(applied.alias("node"), F.lit(0.0).alias("before"), F.col("read_weight").alias("after")),
    )
    both = refined.select("pool", F.explode(sides).alias("s")).groupBy("pool", "s.node").agg(F.sum("s.before").alias("before"), F.sum("s.after").alias("after"))
    return both.filter("before > 0 OR after > 0").withColumns({
        "delta": F.col("after") - F.col("before"), "vanishes": (F.col("before") > 0) & (F.col("after") == 0), "appears": (F.col("before") == 0) & (F.col("after") > 0),
    })


def surviving_reference(shift: DataFrame, nodes: DataFrame, minimum: float = 1.0) -> DataFrame:
    """Reference alleles still supported after refinement, in all pools together."""
    kept = shift.groupBy("node").agg(F.sum("after").alias("after")).filter(F.col("after") >= minimum).select("node")
    return nodes.join(kept, "node", "left_semi").select(F.explode("names").alias("name"), "sequence")
