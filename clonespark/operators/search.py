"""Similarity search: query sequences against a repertoire, neighbours, expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import EMPTY_SLOT, SKETCH_SEEDS, minhash_sketch, sketch_similarity
from ..functions.sequences import blocks, call_set, calls_compatible, distance_limit, hamming, normalize_aa, normalize_nt, text
from ..session import cut
from .lineages import LineageOptions, assign_lineages, eligible
from .simjoin import HOT_GROUP, edit_pairs, hamming_pairs
from .study import scope_key, scope_value

METRICS = ("exact", "substring", "hamming", "edit", "sketch")


@dataclass(frozen=True)
class QueryOptions:
    target: str = "cdr3_nt"  # or "cdr3_aa", "trimmed"
    metric: str = "exact"
    identity: float = 0.85
    locus: str = ""
    v_call: str = ""
    j_call: str = ""
    resolution: str = "gene"
    ambiguity: str = "overlap"
    productive_only: bool = False


def _exact(t: DataFrame, q: DataFrame) -> DataFrame:
    pairs = t.join(q, F.col("target") == F.col("query"))
    return pairs.withColumn("distance", F.lit(0)).withColumn("score", F.lit(1.0))


def _substring(t: DataFrame, q: DataFrame) -> DataFrame:
    """Either string contains the other.

    The contained string starts with its own first k letters (k = the shortest string
    searched), and those appear as a window of the container; both directions are
    equi-joins on that window, the longer side exploding its distinct windows.
    """
    shortest_q = q.agg(F.min(F.length("query"))).first()[0]
    if shortest_q is None:
        return _exact(t, q)
    shortest_t = t.agg(F.min(F.length("target"))).first()[0] or 1

    def windows(value: str, width: int) -> Column:
        last = F.length(value) - width + 1
        return F.when(
            last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(value), i, F.lit(width))))
        ).otherwise(F.array().cast("array<string>"))

    inside_t = t.withColumn("w", F.explode(windows("target", shortest_q))).join(
        q.withColumn("w", F.substring("query", 1, shortest_q)), "w"
    ).filter(F.col("target").contains(F.col("query")))
    inside_q = q.withColumn("w", F.explode(windows("query", shortest_t))).join(
        t.withColumn("w", F.substring("target", 1, shortest_t)), "w"
    ).filter(F.col("query").contains(F.col("target")) & (F.length("query") > F.length("target")))
    columns = [*t.columns, *q.columns]
    both = inside_t.select(*columns).unionByName(inside_q.select(*columns))
    a, b = F.length("target"), F.length("query")
    return both.withColumn("distance", F.abs(a - b)).withColumn("score", F.least(a, b) / F.greatest(a, b))


def _hamming(t: DataFrame, q: DataFrame, identity: float, wildcard: bool) -> DataFrame:
    """Equal lengths within the mismatch limit; N matches anything for nucleotides.

    A block with a wildcard may differ without costing anything, so a pair whose
    strings hold n wildcards together needs ``d + n + 1`` blocks to be sure that one
    agrees. Targets are keyed once per wildcard total that the queries can produce. Each distinct
    target is searched once and its hits go back to all records that have it.
    """
    texts = cut(t.select("target").distinct())
    limit = distance_limit(identity, F.length("target"))

    def wild(value: str) -> Column:
        return F.length(value) - F.length(F.regexp_replace(value, "N", "")) if wildcard else F.lit(0)

    # few distinct small integers, bounded by the longest query
    totals = sorted(r[0] for r in q.select(wild("query")).distinct().collect())
    if not totals:
        return _exact(t, q)

    def keyed(side: DataFrame, value: str, count: Column) -> DataFrame:
        length = F.length(value)
        n = distance_limit(identity, length) + 1 + count
        # when even single letters cannot guarantee agreement the length is the key
        parts = F.when(n <= length, blocks(value, F.greatest(F.lit(1), n))).otherwise(F.array(F.lit("")))
        out = side.withColumn("wild", count).withColumn("len", length)
        return out.select("*", F.posexplode(parts).alias("b", "block"))

    extra = F.explode(F.array(*[F.lit(x) for x in totals]))
    targets = keyed(texts.withColumn("qn", extra), "target", wild("target") + F.col("qn"))
    own = q.withColumn("own", wild("query"))
    target_totals = sorted(r[0] for r in texts.select(wild("target")).distinct().collect())
    queries = keyed(own.withColumn("tn", F.explode(F.array(*[F.lit(x) for x in target_totals]))), "query", F.col("own") + F.col("tn"))
    joined = targets.withColumn("own", F.col("qn")).drop("qn").join(
        queries.drop("tn"), ["own", "wild", "len", "b", "block"]
    )
    scored = joined.withColumn("distance", hamming("target", "query", wildcard)).filter(F.col("distance") <= limit)
    pairs = scored.select("target", *q.columns, "distance").dropDuplicates(["target", "query_index"])
    hits = t.join(pairs, "target").select(*t.columns, *q.columns, "distance")
    return hits.withColumn("score", 1 - F.col("distance") / F.length("target"))


def _edit(t: DataFrame, q: DataFrame, identity: float) -> DataFrame:
    texts = cut(t.select("target").distinct().withColumn("id", F.monotonically_increasing_id()))
    left = texts.select("id", F.lit("").alias("part"), F.col("target").alias("seq"))
    right = q.select(F.col("query_index").alias("id"), F.lit("").alias("part"), F.col("query").alias("seq"))
    pairs = edit_pairs(right, left, identity=identity)
    named = pairs.select(F.col("left_id").alias("query_index"), F.col("right_id").alias("id"), "distance").join(texts, "id").drop("id")
    hits = t.join(named, "target").join(q, "query_index")
    return hits.withColumn("score", 1 - F.col("distance") / F.greatest(F.length("target"), F.length("query")))


def _sketch(t: DataFrame, q: DataFrame, identity: float) -> DataFrame:
    """Sketch similarity at or above the identity.

    Equal slots needed are at least ``ceil(identity * 8)``, so two matching sketches
    agree within any ``9 - needed`` of the slots; the rest need no index entries. A pair that meets in several
    slots counts in the first of them.
    """
    if identity <= 0:
        raise ValueError("sketch search needs an identity above zero")
    slots = len(SKETCH_SEEDS)
    # empty slots shrink the denominator only when both are empty, and then all are
    needed = max(1, -int(-(identity * slots - 1e-9) // 1))
    used = slots - needed + 1

    def keyed(side: DataFrame, name: str) -> DataFrame:
        head = F.slice(F.col(name), 1, used)
        return side.select("*", F.posexplode(head).alias("slot", "hash")).filter(F.col("hash") != EMPTY_SLOT)

    a = keyed(t.withColumn("ts", minhash_sketch("target")), "ts")
    b = keyed(q.withColumn("qs", minhash_sketch("query")), "qs")
    met = F.zip_with(F.slice("ts", 1, used), F.slice("qs", 1, used), lambda x, y: (x == y) & (x != EMPTY_SLOT))
    joined = a.join(b, ["slot", "hash"]).filter(F.array_position(met, True) == F.col("slot") + 1)
    joined = joined.withColumn("score", sketch_similarity(F.col("ts"), F.col("qs")))
    hits = joined.filter(F.col("score") >= identity).select(*t.columns, *q.columns, "score")
    return hits.withColumn("distance", F.round((1 - F.col("score")) * 1000).cast("int"))


def query_records(records: DataFrame, queries: DataFrame, options: QueryOptions) -> DataFrame:
    """All hits ``(ordinal, query_index, score, distance, matched)``.

    ``queries`` has ``query_index`` and ``sequence``, optionally ``locus``, ``v_call``
    and ``j_call`` as per-query constraints.
    """
    if options.metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    value = {"cdr3_nt": "cdr3_nt", "cdr3_aa": "cdr3_aa", "trimmed": "trimmed_nt"}[options.target]
    rows = records.filter("productive") if options.productive_only else records
    if options.locus:
        rows = rows.filter(F.col("locus") == options.locus)
    for column, wanted in (("v_call", options.v_call), ("j_call", options.j_call)):
        if wanted:
            rows = rows.filter(_compatible(F.col(column), F.lit(wanted), options))
    t = rows.select("ordinal", "locus", "v_call", "j_call", F.col(value).alias("target"))
    if options.target != "trimmed":  # an empty text has an empty sketch and is no hit
        t = t.filter("target <> ''")
    clean = normalize_aa("sequence") if options.target == "cdr3_aa" else normalize_nt("sequence")
    optional = [
        (F.col(c) if c in queries.columns else F.lit("")).alias(f"q_{c}") for c in ("locus", "v_call", "j_call")
    ]
    q = queries.select("query_index", clean.alias("query"), *optional).filter("query <> ''")
    if options.target == "trimmed":
        hits = _sketch(t, q, options.identity)
    elif options.metric == "exact":
        hits = _exact(t, q)
    elif options.metric == "substring":
        hits = _substring(t, q)
    elif options.metric == "hamming":
        hits = _hamming(t, q, options.identity, options.target != "cdr3_aa")
    elif options.metric == "edit":
        hits = _edit(t, q, options.identity)
    else:
        raise ValueError("the sketch metric searches trimmed sequences")
    hits = hits.filter((F.col("q_locus") == "") | (F.col("q_locus") == F.col("locus")))
    for column in ("v_call", "j_call"):
        wanted = F.col(f"q_{column}")
        hits = hits.filter((wanted == "") | _compatible(F.col(column), wanted, options))
    matched = F.lit("VDJ k-mer sketch") if options.target == "trimmed" else F.col("target")
    return hits.select("ordinal", "query_index", "score", F.col("distance").cast("int").alias("distance"), matched.alias("matched"))


def _compatible(observed: Column, wanted: Column, options: QueryOptions) -> Column:
    return calls_compatible(
        call_set(observed, options.resolution, options.ambiguity), call_set(wanted, options.resolution, options.ambiguity), options.ambiguity
    )


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "distance", "ordinal", "query_index").limit(limit)


def best_per_lineage(hits: DataFrame, assignments: DataFrame) -> DataFrame:
    """The best member hit of every lineage, with matched members and queries."""
    joined = hits.join(assignments, "ordinal")
    best = joined.groupBy("lineage_id").agg(
        F.min_by(
            F.struct("ordinal", "query_index", "score", "distance", "matched"),
            F.struct(-F.col("score"), F.col("distance"), F.col("ordinal"), F.col("query_index")),
        ).alias("best")
    )
    members = joined.select("lineage_id", "ordinal").distinct().groupBy("lineage_id").agg(F.count(F.lit(1)).alias("matched_sequences"))
    asked = joined.select("lineage_id", "query_index").distinct().groupBy("lineage_id").agg(F.count(F.lit(1)).alias("matched_queries"))
    return best.join(members, "lineage_id").join(asked, "lineage_id").select("lineage_id", "best.*", "matched_sequences", "matched_queries")


# --- neighbours of a lineage ------------------------------------------------


@dataclass(frozen=True)
class NeighbourOptions:
    min_identity: float = 0.7
    metric: str = "hamming"  # or "edit"
    call_policy: str = "both"  # or "either", "ignore"
    hot_group: int = HOT_GROUP


def call_agreement(left: tuple[Column, Column], right: tuple[Column, Column], ambiguity: str) -> Column:
    v = calls_compatible(left[0], right[0], ambiguity)
    j = calls_compatible(left[1], right[1], ambiguity)
    return F.when(v & j, "both").when(v, "v").when(j, "j").otherwise("none")


def lineage_neighbours(
    records: DataFrame, assignments: DataFrame, sources: DataFrame, options: NeighbourOptions, lineage: LineageOptions | None = None
) -> DataFrame:
    """Other lineages with a CDR3 close to one of the source lineages.

    ``sources(lineage_id)``. Study boundary and locus are hard; V/J agreement follows
    the policy. One row per neighbour lineage: its best hit. Equal CDR3s within a
    lineage and call set are one node, so copies do not enter the join.
    """
    lineage = lineage or LineageOptions()
    members = records.join(assignments, "ordinal").filter("cdr3_nt <> ''")
    if lineage.productive_only:
        members = members.filter("productive")
    v = call_set("v_call", lineage.resolution, lineage.ambiguity)
    j = call_set("j_call", lineage.resolution, lineage.ambiguity)
    members = members.select(
        "ordinal", "lineage_id", "weight", "cdr3_nt", "locus", scope_value(lineage.scope).alias("study_group"),
        F.concat_ws("\t", scope_key(lineage.scope), "locus" if lineage.same_locus else F.lit("*")).alias("part"), v.alias("v"), j.alias("j"),
    )
    if options.call_policy == "both":
        members = members.filter((F.size("v") > 0) & (F.size("j") > 0))
    key = ["lineage_id", "part", "cdr3_nt", "v", "j", "locus", "study_group"]
    nodes = cut(members.groupBy(*key).agg(F.min("ordinal").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))
    totals = nodes.groupBy("lineage_id").agg(F.sum("n").alias("unique_members"), F.sum("w").alias("abundance"))
    chosen = sources.select("lineage_id").distinct()
    left = nodes.join(chosen, "lineage_id", "left_semi")
    right = nodes.join(chosen, "lineage_id", "left_anti")
    if options.metric == "edit":
        pairs = edit_pairs(
            left.select("id", "part", F.col("cdr3_nt").alias("seq")),
            right.select("id", "part", F.col("cdr3_nt").alias("seq")),
            identity=options.min_identity, hot_group=options.hot_group,
        )
    else:
        limit = distance_limit(options.min_identity, F.length("cdr3_nt")).alias("lim")
        pairs = hamming_pairs(
            left.select("id", "part", F.col("cdr3_nt").alias("seq"), limit),
            right.select("id", "part", F.col("cdr3_nt").alias("seq"), limit),
            hot_group=options.hot_group,
        )
    a = left.select(F.col("id").alias("left_id"), F.col("lineage_id").alias("source_lineage_id"), F.col("cdr3_nt").alias("source_cdr3"), F.col("v").alias("lv"), F.col("j").alias("lj"))
    b = right.select(F.col("id").alias("right_id"), "lineage_id", "cdr3_nt", "locus", "study_group", "v", "j")
    scored = pairs.join(a, "left_id").join(b, "right_id")
    longer = F.greatest(F.length("source_cdr3"), F.length("cdr3_nt"))
    agreement = call_agreement((F.col("lv"), F.col("lj")), (F.col("v"), F.col("j")), lineage.ambiguity)
    scored = scored.withColumn("identity", 1 - F.col("distance") / longer).withColumn("agreement", agreement)
    accepted = {"ignore": F.lit(True), "either": F.col("agreement") != "none", "both": F.col("agreement") == "both"}[options.call_policy]
    rank = F.when(F.col("agreement") == "both", 2).when(F.col("agreement") == "none", 0).otherwise(1)
    best = scored.filter(accepted).groupBy("lineage_id").agg(
        F.min_by(
            F.struct(
                "source_lineage_id", F.col("left_id").alias("source_ordinal"), F.col("right_id").alias("candidate_ordinal"),
                "identity", "distance", (F.length("cdr3_nt") - F.length("source_cdr3")).alias("length_delta"), "agreement",
                rank.alias("agreement_rank"), "locus", F.length("cdr3_nt").alias("cdr3_length"), "study_group",
            ),
            F.struct(-F.col("identity"), -rank, F.col("left_id"), F.col("right_id")),
        ).alias("h")
    )
    return best.select("lineage_id", "h.*").join(totals, "lineage_id")


def top_neighbours(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("identity"), F.desc("agreement_rank"), F.desc("abundance"), "lineage_id").limit(limit)


def combined_neighbours(cdr3_hits: DataFrame, germline_hits: DataFrame) -> DataFrame:
    """CDR3 and germline neighbours of a lineage in one ranking (outer merge)."""
    a = cdr3_hits.select("lineage_id", F.col("identity").alias("cdr3_identity"))
    b = germline_hits.select("lineage_id", "germline_identity")
    both = a.join(b, "lineage_id", "full_outer")
    return both.withColumn("best_identity", F.greatest(F.coalesce("cdr3_identity", F.lit(0.0)), F.coalesce("germline_identity", F.lit(0.0))))


def expand_linkage(records: DataFrame, seeds: DataFrame, options: LineageOptions | None = None, rounds: bool = False) -> DataFrame:
    """Everything single-linkage reaches from the seeds: ``ordinal``, with ``rounds`` also the number of steps, ``round``.

    What is reached are the components that hold a seed, so one contraction of the graph and a semi join
    answer for any number of seeds and chains of any length. Steps are only known to a breadth-first search, whose
    frontier is a DataFrame: a round joins newly reached sequences on the blocks of the lineage assignment, and
    there are as many rounds as steps.
    """
    if not rounds:
        assigned = cut(assign_lineages(records, options))
        wanted = assigned.join(seeds.select("ordinal"), "ordinal", "left_semi").select("lineage_id").distinct()
        return assigned.join(wanted, "lineage_id", "left_semi").select("ordinal")
    options = options or LineageOptions()
    rows = eligible(records, options).select("ordinal", "scope", "hard_locus", "tokens", "cdr3_nt")
    key = ["scope", "hard_locus", "tokens", "cdr3_nt"]
    nodes = cut(rows.groupBy(*key).agg(F.min("ordinal").alias("id")))
    probe = nodes.withColumn("token", F.explode("tokens")).select(
        "id", F.concat_ws("\t", "scope", "hard_locus", "token").alias("part"), F.col("cdr3_nt").alias("seq"),
        distance_limit(options.identity, F.length("cdr3_nt")).alias("lim"),
    )
    start = rows.join(seeds.select("ordinal"), "ordinal", "left_semi").join(nodes, key).select("id").distinct()
    frontier = cut(start.withColumn("round", F.lit(0)))
    reached = frontier
    step = 0
    while not frontier.isEmpty():
        step += 1
        active = probe.join(frontier.select("id"), "id", "left_semi")
        rest = probe.join(reached.select("id"), "id", "left_anti")
        pairs = hamming_pairs(active, rest, hot_group=options.hot_group)
        frontier = cut(pairs.select(F.col("right_id").alias("id")).distinct().withColumn("round", F.lit(step)))
        reached = reached.unionByName(frontier)
    named = nodes.join(reached, "id").select(*key, "round")
    return rows.join(named, key).select("ordinal", "round")
