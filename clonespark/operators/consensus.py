"""Lineage alignments: anchored rows, inferred germlines and column profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import GAP, LETTER_KIND, dealt, ends_of, flat, pieces
from ..functions.sequences import clean_alignment, is_true_flag, number, text
from ..functions.kernels import edit_distance_wildcard, minhash_sketch, sketch_similarity, EMPTY_SLOT
from ..session import cut

BASES = ("A", "C", "G", "T")


def normalized_alignment(value: Column | str) -> Column:
    return F.regexp_replace(F.replace(clean_alignment(value), F.lit("U"), F.lit("T")), "[^ACGTN-]", "N")


def anchored_rows(table: DataFrame, productive_only: bool = False) -> DataFrame:
    """Reads and germlines of a lineage placed on V-reference columns.

    Left padding is the reported germline start; right padding fills the longer of the
    pair. Padding to the width of the lineage is left to ``padded`` so that long
    lineages need no second pass unless an alignment is printed.
    """
    rows = table.filter(is_true_flag("productive")) if productive_only else table
    raw = normalized_alignment(F.when(text("sequence_alignment") != "", text("sequence_alignment")).otherwise(text("sequence")))
    given = normalized_alignment("germline_alignment")
    germline = F.when(given != "", given).otherwise(F.regexp_replace(raw, "[ACGT]", "N"))
    start = F.floor(number("v_germline_start"))
    left = F.when(start >= 1, start - 1).otherwise(0).cast("int")
    width = F.greatest(F.length("raw"), F.length("given"))
    placed = rows.select("*", raw.alias("raw"), germline.alias("given"), left.alias("left"))
    return placed.withColumn("aligned_read", F.concat(F.repeat(F.lit("-"), F.col("left")), F.rpad("raw", width, "-"))).withColumn(
        "aligned_germline", F.concat(F.repeat(F.lit("-"), F.col("left")), F.rpad("given", width, "-"))
    ).drop("raw", "given", "left")


def padded(anchored: DataFrame) -> DataFrame:
    """Rows of each lineage padded to one width."""
    width = anchored.groupBy("lineage_id").agg(F.max(F.length("aligned_read")).alias("width"))
    return anchored.join(width, "lineage_id").select(
        "lineage_id", "ordinal", "sequence_id",
        F.rpad("aligned_read", F.col("width"), "-").alias("aligned_read"), F.rpad("aligned_germline", F.col("width"), "-").alias("aligned_germline"),
    )


_BASE = np.full(256, 4, np.uint8)
for _code, _letter in enumerate(BASES):
    _BASE[ord(_letter)] = _code
_BASE[ord("U")] = _BASE[ord("T")]


@F.arrow_udf(T.StructType([T.StructField("matches", T.IntegerType()), T.StructField("compared", T.IntegerType())]))
def identity_counts(query: pa.Array, germline: pa.Array) -> pa.Array:
    """Matches and compared columns of upper-case aligned pairs: those where both have a base; nothing for null."""
    texts, others = ([x or "" for x in side.to_pylist()] for side in (query, germline))
    found = [np.zeros((2, 0), np.int32)]
    for part in pieces(np.fromiter((len(q) + len(g) for q, g in zip(texts, others, strict=True)), np.int64, len(texts))):
        (q, q0), (g, g0) = flat(texts[part]), flat(others[part])
        n = len(q0) - 1
        owner, nth = dealt(np.minimum(np.diff(q0), np.diff(g0)))
        a, b = _BASE[np.minimum(q[q0[owner] + nth], 255)], _BASE[np.minimum(g[g0[owner] + nth], 255)]
        known = (a < 4) & (b < 4)
        found.append(np.stack([np.bincount(owner[known & (a == b)], minlength=n), np.bincount(owner[known], minlength=n)]).astype(np.int32))
    whole = np.concatenate(found, axis=1)
    return pa.StructArray.from_arrays([pa.array(whole[0]), pa.array(whole[1])], ["matches", "compared"])


def _identity(query: str, germline: str, wanted: Column | None = None) -> Column:
    """Matches and compared columns of an aligned pair; only for rows that are ``wanted``."""
    q, g = F.upper(text(query)), F.upper(text(germline))
    counts = identity_counts.asNondeterministic()
    return counts(q, g) if wanted is None else counts(F.when(wanted, q), F.when(wanted, g))


def closest_members(table: DataFrame) -> DataFrame:
    """Per lineage, the member nearest its germline.

    Order: informative segments, mean V/J identity, pooled identity, compared columns,
    earliest ordinal. A segment without aligned columns may use its reported identity.
    """
    names = table.columns
    staged = table
    for s in "vj":
        if {f"{s}_sequence_alignment", f"{s}_germline_alignment"} <= set(names):
            staged = staged.withColumn(f"_{s}", _identity(f"{s}_sequence_alignment", f"{s}_germline_alignment"))
            match, compared = F.col(f"_{s}.matches"), F.col(f"_{s}.compared")
        else:
            match, compared = F.lit(0), F.lit(0)
        staged = staged.withColumn(f"_{s}m", match).withColumn(f"_{s}c", compared)
        reported = number(f"{s}_identity") if f"{s}_identity" in names else F.lit(None).cast("double")
        reported = F.when((reported >= 0) & (reported <= 1), reported)
        staged = staged.withColumn(f"_{s}i", F.when(F.col(f"_{s}c") > 0, F.col(f"_{s}m") / F.col(f"_{s}c")).otherwise(reported))
    segments = F.col("_vi").isNotNull().cast("int") + F.col("_ji").isNotNull().cast("int")
    none = segments == 0
    staged = staged.withColumn("_whole", _identity("sequence_alignment", "germline_alignment", none))
    whole_match, whole_compared = F.col("_whole.matches"), F.col("_whole.compared")
    mean = (F.coalesce("_vi", F.lit(0.0)) + F.coalesce("_ji", F.lit(0.0))) / F.nullif(segments, F.lit(0))
    compared = F.when(none, whole_compared).otherwise(F.col("_vc") + F.col("_jc"))
    matches = F.when(none, whole_match).otherwise(F.col("_vm") + F.col("_jm"))
    pooled = matches / F.nullif(compared, F.lit(0))
    scored = staged.withColumn("_segments", segments).withColumn("_compared", compared).withColumn("_pooled0", pooled)
    scored = scored.withColumn("_mean", F.when(none, F.coalesce("_pooled0", F.lit(-1.0))).otherwise(mean))
    scored = scored.withColumn("_pooled", F.coalesce("_pooled0", "_mean"))
    order = F.struct(-F.col("_segments"), -F.col("_mean"), -F.col("_pooled"), -F.col("_compared"), F.col("ordinal"))
    best = scored.groupBy("lineage_id").agg(F.min_by(F.struct("ordinal", F.col("_mean").alias("vj_identity"), F.col("_compared").alias("compared")), order).alias("b"))
    return best.select("lineage_id", "b.*")


def closest_germline(table: DataFrame) -> DataFrame:
    """Germline of each lineage from its closest member; N columns take the member's base."""
    chosen = closest_members(table).select("ordinal")
    rows = anchored_rows(table.join(chosen, "ordinal", "left_semi"))
    uca = F.array_join(
        F.zip_with(
            F.split("aligned_germline", ""), F.split("aligned_read", ""),
            lambda g, r: F.when((g == "N") & r.isin(*BASES), r).otherwise(g),
        ),
        "",
    )
    return rows.select("lineage_id", "ordinal", F.col("aligned_germline").alias("template"), uca.alias("uca")).withColumn(
        "trimmed_uca", F.regexp_replace("uca", "^-+|-+$", "")
    )


VOTES = [f"{side}_{b}" for side in ("g", "q") for b in BASES]


#: Lineage columns whose counts a task holds before it hands them on.
HELD_COLUMNS = 1 << 19


def _counts(ids: np.ndarray, reads: list[str], germlines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (votes and coverage) by lineage and column, one lineage behind the other, and where each of them begins."""
    q, starts = flat(reads)
    g, _ = flat(germlines)
    width = np.ones(ids.max(initial=-1) + 1, np.int64)
    np.maximum.at(width, ids, np.diff(starts) + 1)
    first = ends_of(width)
    owner, nth = dealt(np.diff(starts))
    cell = first[ids[owner]] + nth + 1
    by_kind = [np.bincount(cell * 6 + LETTER_KIND[np.minimum(side, 255)], minlength=6 * first[-1]).reshape(-1, 6) for side in (g, q)]
    covered = by_kind[1].sum(axis=1) - np.bincount(cell[(q == GAP) & (g == GAP)], minlength=first[-1])
    covered[first[:-1]] = np.bincount(ids, minlength=len(width))
    return np.column_stack([by_kind[0][:, :4], by_kind[1][:, :4], covered]), first


def _tallies(anchored: DataFrame) -> DataFrame:
    """Base counts per lineage and column; column 0 has the number of members as its coverage.

    A task counts its members before anything leaves it, so that it hands on a row per lineage and column and not
    one per letter, and holds a bounded number of columns; the counts of tasks are added up by a two-level aggregate.
    """
    kind = anchored.schema["lineage_id"].dataType
    names = ["lineage_id", "column", *VOTES, "coverage"]

    def counted(batches):
        held: dict = {}
        size = 0

        def rows():
            keys, counts = list(held), list(held.values())
            of, column = dealt(np.array([len(c) for c in counts]))
            whole = np.concatenate(counts)
            ids = pa.array(keys, id_type).take(pa.array(of))
            return pa.RecordBatch.from_arrays([ids, pa.array(column.astype(np.int32)), *[pa.array(np.ascontiguousarray(whole[:, i])) for i in range(whole.shape[1])]], names=names)

        for batch in batches:
            id_type = batch.schema.field("lineage_id").type
            pairs = [("", "") if q is None or g is None else (q, g) for q, g in zip(batch.column("q").to_pylist(), batch.column("g").to_pylist(), strict=True)]
            pairs = [(q, g) if len(q) == len(g) else (q.ljust(len(g), "-"), g.ljust(len(q), "-")) for q, g in pairs]
            for part in pieces(np.fromiter((len(q) for q, _ in pairs), np.int64, len(pairs))):
                ids = batch.column("lineage_id").slice(part.start, part.stop - part.start).dictionary_encode("encode")
                counts, first = _counts(ids.indices.to_numpy(zero_copy_only=False), [q for q, _ in pairs[part]], [g for _, g in pairs[part]])
                for n, key in enumerate(ids.dictionary.to_pylist()):
                    new, old = counts[first[n] : first[n + 1]], held.get(key)
                    if old is None:
                        held[key] = new.copy()
                        size += len(new)
                    elif len(old) >= len(new):
                        old[: len(new)] += new
                    else:
                        held[key] = new.copy()
                        held[key][: len(old)] += old
                        size += len(new) - len(old)
                if size > HELD_COLUMNS:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()

    texts = anchored.select("lineage_id", F.col("aligned_read").alias("q"), F.col("aligned_germline").alias("g"))
    parts = texts.mapInArrow(counted, f"lineage_id {kind.simpleString()}, `column` int, {', '.join(f'{v} long' for v in VOTES)}, coverage long")
    return parts.groupBy("lineage_id", "column").agg(*[F.sum(c).alias(c) for c in (*VOTES, "coverage")])


def column_votes(anchored: DataFrame) -> DataFrame:
    """Base counts per lineage and column, for germline and read: one row per column, whatever the size of the lineage."""
    return _tallies(anchored).filter(F.col("column") > 0)


def _plurality(side: str) -> tuple[Column, Column, Column]:
    """Leading base, its count and the votes; NULL base when tied."""
    counts = [F.col(f"{side}_{b}") for b in BASES]
    top = F.greatest(*counts)
    votes = counts[0] + counts[1] + counts[2] + counts[3]
    leaders = sum((F.when(c == top, 1).otherwise(0) for c in counts[1:]), F.when(counts[0] == top, 1).otherwise(0))
    base = F.when((top > 0) & (leaders == 1), F.coalesce(*[F.when(c == top, F.lit(b)) for c, b in zip(counts, BASES, strict=True)]))
    return base, top, votes


def consensus_columns(anchored: DataFrame) -> DataFrame:
    """Consensus germline per lineage column.

    A germline base needs 80 % of informative members, a read base 60 % where the
    germline is open; endpoints need coverage by a fifth of the members.
    """
    tallies = cut(_tallies(anchored))  # read twice
    members = tallies.filter(F.col("column") == 0).select("lineage_id", F.col("coverage").alias("members"))
    votes = tallies.filter(F.col("column") > 0).join(members, "lineage_id")
    g_base, g_top, g_votes = _plurality("g")
    q_base, q_top, q_votes = _plurality("q")
    known = g_base.isNotNull() & (F.try_divide(g_top, g_votes) >= 0.8)
    open_ = F.when(F.col("coverage") > 0, "N").otherwise("-")
    observed = F.when(q_base.isNotNull() & (F.try_divide(q_top, q_votes) >= 0.6), q_base).otherwise(open_)
    return votes.select(
        "lineage_id", "column", "coverage", "members",
        F.when(known, g_base).otherwise(open_).alias("template"),
        F.when(known, g_base).otherwise(observed).alias("uca"),
        ((g_votes > 0) & ~known).alias("conflict"),
        (F.col("coverage") >= F.greatest(F.lit(1), F.ceil(F.col("members") * 0.2))).alias("supported"),
    )


def consensus_germline(anchored: DataFrame) -> DataFrame:
    """Consensus columns joined into sequences, with supported endpoints only."""
    columns = consensus_columns(anchored)
    # one row per alignment column, not per member
    packed = columns.groupBy("lineage_id").agg(
        F.array_sort(F.collect_list(F.struct("column", "template", "uca"))).alias("c"),
        F.min(F.when(F.col("supported"), F.col("column"))).alias("start_column"),
        F.max(F.when(F.col("supported"), F.col("column"))).alias("end_column"),
        F.count_if("conflict").alias("conflicting_columns"),
        F.first("members").alias("rows_used"),
    )
    inside = F.filter("c", lambda x: x["column"].between(F.col("start_column"), F.col("end_column")))
    return packed.select(
        "lineage_id", "rows_used", "start_column", "end_column", "conflicting_columns",
        F.array_join(F.transform("c", lambda x: x["template"]), "").alias("template"),
        F.array_join(F.transform("c", lambda x: x["uca"]), "").alias("uca"),
        F.array_join(F.transform(inside, lambda x: x["uca"]), "").alias("trimmed_uca"),
    )


def germline_sketches(table: DataFrame) -> DataFrame:
    """One sketch per lineage from its best-covered, least mutated member."""
    q = normalized_alignment(F.when(text("sequence_alignment") != "", text("sequence_alignment")).otherwise(text("sequence")))
    g = normalized_alignment("germline_alignment")
    n = F.greatest(F.length("q"), F.length("g"))
    rows = table.select("ordinal", "lineage_id", text("locus").alias("locus"), "study_group", q.alias("q"), g.alias("g"))
    pairs = F.zip_with(F.split(F.rpad("q", n, "-"), ""), F.split(F.rpad("g", n, "-"), ""), lambda a, b: F.struct(a.alias("q"), b.alias("g")))
    rows = rows.withColumn("p", pairs)
    known = F.size(F.filter("p", lambda c: c["g"].isin(*BASES)))
    miss = F.size(F.filter("p", lambda c: c["g"].isin(*BASES) & c["q"].isin(*BASES) & (c["q"] != c["g"])))
    proxy = F.array_join(
        F.transform("p", lambda c: F.when(c["g"].isin(*BASES), c["g"]).when(c["q"].isin(*BASES), c["q"]).otherwise("N")), ""
    )
    rows = rows.select("ordinal", "lineage_id", "locus", "study_group", (known * 1000 + n - miss * 25).alias("quality"), proxy.alias("proxy"))
    best = rows.groupBy("lineage_id").agg(
        F.min_by(F.struct("ordinal", "locus", "study_group", "proxy"), F.struct(-F.col("quality"), F.col("ordinal"))).alias("b")
    )
    return best.select("lineage_id", "b.*").withColumn("sketch", minhash_sketch("proxy"))


def screen_germlines(index: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Lineages of the same locus and study group whose germline sketch shares a slot.

    All of them by default; ``limit`` keeps the most similar ones of each source. Verify by
    ``germline_identity`` before cutting: the sketch only screens.

    ``sources(source_lineage_id, locus, study_group, sketch)``. Lineages that share no
    sketch slot have similarity zero and are not candidates.
    """

    def slots(side: DataFrame) -> DataFrame:
        return side.select("*", F.posexplode("sketch").alias("slot", "hash")).filter(F.col("hash") != EMPTY_SLOT)

    a = slots(sources.withColumnRenamed("sketch", "source_sketch").withColumn("sketch", F.col("source_sketch"))).drop("sketch")
    b = slots(index.select("lineage_id", F.col("ordinal").alias("representative_ordinal"), "locus", "study_group", "sketch"))
    pairs = a.join(b, ["locus", "study_group", "slot", "hash"]).filter("lineage_id <> source_lineage_id")
    scored = pairs.groupBy("source_lineage_id", "lineage_id", "representative_ordinal").agg(
        F.first(sketch_similarity(F.col("source_sketch"), F.col("sketch"))).alias("similarity")
    )
    if limit is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("source_lineage_id").orderBy(F.desc("similarity"), "lineage_id"))
    return scored.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def germline_identity(left: str, right: str) -> Column:
    """Identity of two inferred germlines, N matching anything."""
    a, b = F.regexp_replace(normalized_alignment(left), "^-+|-+$", ""), F.regexp_replace(normalized_alignment(right), "^-+|-+$", "")
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.greatest(F.lit(0.0), 1 - edit_distance_wildcard(a, b) / longer)).otherwise(0.0)


def region_labels(anchored: DataFrame, regions: tuple[str, ...] = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4")) -> DataFrame:
    """Majority region per alignment column, from the members' own coordinates.

    A read has few runs of columns of one region. Only where they begin and end leaves the read; how many reads
    cover a column is added up along the columns of a lineage and region.
    """
    names = [r for r in regions if f"{r}_start" in anchored.columns]
    start = F.greatest(F.lit(1), F.coalesce(F.floor(number("v_sequence_start")), F.lit(1)))
    # a region without a start or an end has no columns
    bounds = [F.coalesce(F.col(f"{r}_{e}").cast("int"), F.lit(0)).alias(f"{r}_{e}") for r in names for e in ("start", "end")]
    cells = anchored.select("lineage_id", F.coalesce("aligned_read", F.lit("")).alias("aligned_read"), start.cast("long").alias("s"), *bounds)

    def runs(batches):
        for batch in batches:
            texts = batch.column("aligned_read").to_pylist()
            first_base = batch.column("s").to_numpy()
            limits = [(batch.column(f"{r}_start").to_numpy(), batch.column(f"{r}_end").to_numpy()) for r in names]
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
                codes, starts = flat(texts[part])
                owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                base = codes != GAP
                before = ends_of(base)
                position = first_base[part][owner] + before[:-1] - before[starts[:-1]][owner]
                label = np.full(len(codes), -1, np.int8)
                for k in reversed(range(len(names))):
                    low, high = limits[k][0][part][owner], limits[k][1][part][owner]
                    label[base & (low > 0) & (position >= low) & (position <= high)] = k
                edge = np.ones(len(codes) + 1, bool)
                edge[1:-1] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(edge)
                labelled = label[at[:-1]] >= 0
                first, last = at[:-1][labelled], at[1:][labelled]
                of = owner[first]
                both = np.concatenate([of, of])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lineage_id").take(pa.array(both + part.start)), pa.array(names, pa.string()).take(pa.array(np.tile(label[first], 2))),
                        pa.array((np.concatenate([first, last]) - starts[both] + 1).astype(np.int32)), pa.array(np.repeat(np.array([1, -1]), len(first))),
                    ],
                    names=["lineage_id", "region", "column", "delta"],
                )

    kind = anchored.schema["lineage_id"].dataType.simpleString()
    changes = cells.mapInArrow(runs, f"lineage_id {kind}, region string, column int, delta long").groupBy("lineage_id", "region", "column").agg(F.sum("delta").alias("delta"))
    along = Window.partitionBy("lineage_id", "region").orderBy("column")
    covered = changes.select("lineage_id", "region", "column", F.sum("delta").over(along).alias("n"), F.lead("column").over(along).alias("next")).filter("n > 0")
    counts = covered.select("lineage_id", "region", "n", F.explode(F.sequence(F.col("column"), F.col("next") - 1)).alias("column"))
    return counts.groupBy("lineage_id", "column").agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("region"))


def character_frequencies(anchored: DataFrame) -> DataFrame:
    """Smoothed nucleotide and gap frequencies over an alignment (one count added each)."""
    states = (*BASES, "-")
    counts = anchored.select(F.explode(F.split("aligned_read", "")).alias("state")).filter(F.col("state").isin(*states)).groupBy("state").agg(
        F.count(F.lit(1)).alias("n")
    )
    every = anchored.sparkSession.createDataFrame([(s,) for s in states], "state string")
    joined = every.join(counts, "state", "left").select("state", (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("n"))
    total = joined.agg(F.sum("n")).scalar()
    return joined.select("state", (F.col("n") / total).alias("frequency"))


def stratified_rows(table: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` rows, taking one per lineage in turn.

    A lineage of any size can contribute at most ``limit`` rows, so each task keeps a
    bounded heap per lineage (``max_by`` with k would be its built-in form); the rank
    within a lineage comes from a window over rows already cut to the limit.
    """
    from pyspark.sql import Window

    # range-partitioned ordinals: the k smallest of each lineage per slice, then overall
    slice_no = F.pmod(F.xxhash64("ordinal"), F.lit(64))
    inner = Window.partitionBy("lineage_id", slice_no).orderBy("ordinal")
    trimmed = table.withColumn("_k", F.row_number().over(inner)).filter(F.col("_k") <= limit).drop("_k")
    outer = Window.partitionBy("lineage_id").orderBy("ordinal")
    ranked = trimmed.withColumn("turn", F.row_number().over(outer))
    first = ranked.groupBy("lineage_id").agg(F.min("ordinal").alias("first_seen"))
    return ranked.join(first, "lineage_id").orderBy("turn", "first_seen").limit(limit).drop("first_seen")


def member_page(members: DataFrame, lineage_id: int, offset: int, limit: int) -> DataFrame:
    """One page of a lineage's members in table order, plus one row that says "has more"."""
    return members.filter(F.col("lineage_id") == lineage_id).orderBy("ordinal").offset(offset).limit(limit + 1)
