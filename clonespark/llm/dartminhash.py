"""Near duplicates by DartMinHash signatures of weighted shingle sets.

Darts are a Poisson process over every element's weight and rank axes, drawn from hashes of the
element alone. The weight axis is cut into regions ``[0, 1), [1, 2), [2, 4), ...``; in
each of them darts arrive along the rank axis at the rate of the region's width. A set
owns the darts below its weights. Each dart falls on one coordinate of the signature and the
earliest per coordinate stays, so two sets agree on a coordinate with the probability
of their weighted Jaccard similarity. Only darts up to rank ``k (ln k + 2) / weight`` are
thrown at first, about ``k (ln k + 2)`` for a set of any size; the few sets with an empty coordinate throw
up to twice that rank, and so on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import contracted
from .kernels import U, distinct_keys, mix, ngram_hashes, slices, stream, text_bytes, window_starts, words_in, words_of
from .storage import narrowed, stored

BANDS, ROWS = 32, 5
#: Bytes of text taken up at once; a few hundred bytes of arrays go with each shingle.
PIECE = 512 << 10
#: Members of a bucket of which all pairs of different classes are compared if its pivot does not settle it: of
#: bands, and of the buckets (pivot, shingle) that come after. Larger ones are split by a further pivot.
SMALL, MEDIUM = 24, 128
#: Rows with texts or lists of shingles that a task takes at least.
WIDE_PART = 256


def shingles(words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shingle)``: windows of ``size`` words; a shorter text is one shingle of all its words."""
    at = np.flatnonzero(window_starts(words.first, size))
    rows, keys = words.rows[at], ngram_hashes(hashes, size)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        total = mix(sequence_hash(words, hashes, 7)[short])
        rows, keys = np.concatenate([rows, short]), np.concatenate([keys, total])
    return rows, keys


def sequence_hash(words, hashes: np.ndarray, seed: int) -> np.ndarray:
    """One hash of the whole word sequence of each row."""
    out = np.zeros(len(words.counts), U)
    if len(hashes):
        values = hashes * stream(seed + 31, int(words.counts.max()))[words.positions]
        full = words.counts > 0
        out[full] = np.add.reduceat(values, words.first[:-1][full])
    return mix(out + words.counts.astype(U))


def weighted(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(row, element)`` with their counts as weights."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], keys[first], np.diff(np.append(first, len(keys))).astype(float)


def signatures(n_rows: int, rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Dart signatures (``n_rows`` x ``k``) of weighted sets; a row without elements is all zero.

    Weights are any positive numbers.
    """
    out = np.zeros((n_rows, k), U)
    best = np.full((n_rows, k), np.inf)
    total = np.bincount(rows, weights, n_rows)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n_rows), where=total > 0)
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(int) + 1
    line = np.repeat(np.arange(len(rows)), levels)
    level = np.arange(len(line)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    salt = mix(elements[line] + stream(seed + 41, 64)[level])
    cells, own = rows[line], weights[line]
    open_rows = total > 0
    while open_rows.any():
        active = np.flatnonzero(open_rows[cells])
        rank, step = np.zeros(len(active)), np.zeros(len(active), np.int64)
        while len(active):
            # as many arrivals of each line at once as are expected up to the limit
            ahead = np.clip(np.ceil(1.2 * (limit[cells[active]] - rank) * width[active]), 1, 256).astype(np.int64)
            line = np.repeat(active, ahead)
            first = np.cumsum(ahead) - ahead
            nth = np.arange(len(line)) - np.repeat(first, ahead) + np.repeat(step, ahead)
            draw = mix(salt[line] + (nth + 1).astype(U) * U(0x9E3779B97F4A7C15))
            gaps = -np.log(((draw >> U(11)).astype(float) + 0.5) / 2.0**53) / width[line]
            total_gap = np.cumsum(gaps)
            reached = total_gap + np.repeat(rank - (total_gap[first] - gaps[first]), ahead)
            inside = reached <= limit[cells[line]]
            last = first + ahead - 1
            more = inside[last]
            active, rank, step = active[more], reached[last][more], (step + ahead)[more]
            line, reached, draw = line[inside], reached[inside], draw[inside]
            second = mix(draw ^ U(0xA5A5A5A5A5A5A5A5))
            height = low[line] + width[line] * ((second >> U(40)).astype(float) / 2.0**24)
            owned = height < own[line]
            at = cells[line[owned]] * k + ((second[owned] & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)
            r = reached[owned]
            np.minimum.at(best.reshape(-1), at, r)
            won = best.reshape(-1)[at] == r
            out.reshape(-1)[at[won]] = draw[owned][won]
        open_rows &= np.isinf(best).any(axis=1)
        limit[open_rows] *= 2
        best[open_rows], out[open_rows] = np.inf, 0
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    factors = stream(53, bands * rows).reshape(bands, rows)
    return mix((signature.reshape(len(signature), bands, rows) * factors).sum(axis=2, dtype=U))


def sketch(docs: DataFrame, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, two hashes of the word sequence and the band hashes of every text that has words."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                words = words_of(piece.column("text"))
                hashes = words.hashes()
                n = len(words.counts)
                signature = signatures(n, *weighted(*shingles(words, hashes, size)), bands * rows)
                some = np.flatnonzero(words.counts > 0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id").take(pa.array(some)),
                    "c1": pa.array(sequence_hash(words, hashes, 1)[some].view(np.int64)), "c2": pa.array(sequence_hash(words, hashes, 2)[some].view(np.int64)),
                    "bands": pa.array(list(band_hashes(signature[some], bands, rows).view(np.int64)), pa.list_(pa.int64())),
                })

    return docs.mapInArrow(run, "doc_id long, c1 long, c2 long, bands array<long>")


COMPARED = "left_id long, right_id long, wide boolean, similarity double, shared long, size long, novel array<struct<s:long,rest:long>>"


def similarity(pairs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Exact weighted Jaccard of the shingles of two texts per row.

    ``shared`` is the weight of the common part and ``size`` that of the right text. Where ``wide`` is set,
    ``novel`` holds the shingles that the right text has more often than the left one, in the order of their
    hashes, each with the weight from there on, and without the last ones, which a third text can't be similar
    by alone (weighted prefix filter).
    """

    def run(batches):
        for batch in batches:
            width = np.diff(text_bytes(batch.column("left_text"))[1]) + np.diff(text_bytes(batch.column("right_text"))[1])
            group = np.cumsum(width) // (2 * PIECE)
            for g in np.unique(group):
                span = np.flatnonzero(group == g)
                yield compare(batch.slice(int(span[0]), len(span)), size, threshold)

    return pairs.select("left_id", "right_id", "left_text", "right_text", "wide").mapInArrow(run, COMPARED)


def compare(piece: pa.RecordBatch, size: int, threshold: float) -> pa.RecordBatch:
    sides = []
    for name in ("left_text", "right_text"):
        data, offsets = text_bytes(piece.column(name))
        words = words_in(data, offsets)
        sides.append(shingles(words, words.hashes(), size))
    n_pairs = piece.num_rows
    pair = np.concatenate([s[0] for s in sides])
    keys = np.concatenate([s[1] for s in sides])
    salt = mix(np.arange(n_pairs, dtype=U) + U(1))
    distinct, example, inverse = distinct_keys(keys ^ salt[pair])
    n = len(sides[0][1])
    left = np.bincount(inverse[:n], minlength=len(distinct))
    right = np.bincount(inverse[n:], minlength=len(distinct))
    of = pair[example] if len(example) else pair
    both = np.bincount(of, np.minimum(left, right), n_pairs)
    either = np.bincount(of, np.maximum(left, right), n_pairs)
    total = np.bincount(of, right, n_pairs)
    wide = piece.column("wide").to_numpy(zero_copy_only=False).astype(bool)
    extra = np.where(wide[of], np.maximum(right - left, 0), 0) if len(of) else np.zeros(0, np.int64)
    beyond = np.flatnonzero(extra)
    codes = keys[example[beyond]].view(np.int64) if len(beyond) else np.zeros(0, np.int64)
    order = np.lexsort((codes, of[beyond])) if len(beyond) else np.zeros(0, np.int64)
    owner, codes, extra = of[beyond][order], codes[order], extra[beyond][order]
    # a similar text shares at least ``threshold`` of this one's weight; what it can't share with the left text it
    # shares here, so one of the shingles from which on there is that much weight left
    needed = np.maximum(1, np.ceil(threshold * total - 1e-9) - both)
    first = np.searchsorted(owner, np.arange(n_pairs + 1))
    before = np.concatenate([[0], np.cumsum(extra)])
    kept = before[first[owner + 1]] - before[:-1] >= needed[owner] if len(owner) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(kept)])[first]
    rest = before[first[owner + 1]] - before[:-1] if len(owner) else before[:0]
    values = pa.StructArray.from_arrays([pa.array(codes[kept], pa.int64()), pa.array(rest[kept], pa.int64())], ["s", "rest"])
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    return pa.RecordBatch.from_pydict({
        "left_id": piece.column("left_id"), "right_id": piece.column("right_id"), "wide": piece.column("wide"),
        "similarity": pa.array(np.divide(both, either, out=np.zeros(n_pairs), where=either > 0)),
        "shared": pa.array(both.astype(np.int64)), "size": pa.array(total.astype(np.int64)), "novel": lists,
    })


def _relabel(label: DataFrame, links: DataFrame, n_leads: int, n_links: int) -> DataFrame:
    """Classes of all leads after links ``(left_id, right_id)`` between leads; ``n_links`` rows were read for them."""
    left = label.select(F.col("lead").alias("left_id"), F.col("class").alias("a"))
    right = label.select(F.col("lead").alias("right_id"), F.col("class").alias("b"))
    edges = links.join(left, "left_id").join(right, "right_id").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(narrowed(edges.distinct(), n_links), "dart-links")
    n = edges.count()
    if not n:
        return label
    merged = contracted(edges, n).select(F.col("id").alias("class"), "component")
    changed = label.join(merged, "class", "left").select("lead", F.coalesce("component", "class").alias("class"))
    return stored(narrowed(changed, n_leads), "dart-classes")


def _joined_groups(large: DataFrame) -> DataFrame:
    """``group, left_id, right_id``: buckets of ``(pivot, lead)`` whose members mostly have one other pivot go to it.

    The members of each bucket stay together. A group of near copies is in many buckets, some of which
    lack the common original; all of them get it as their pivot.
    """
    sizes = large.groupBy("pivot").agg(F.count("*").alias("n"))
    main = large.join(sizes, "pivot").groupBy("lead").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("main"))
    votes = large.join(main, "lead").groupBy("pivot", "main").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("pivot").agg(F.max_by("main", F.struct("n", -F.col("main"))).alias("left_id"))
    return large.join(chosen, "pivot").select(F.col("left_id").alias("group"), "left_id", F.col("lead").alias("right_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id``: the group of near duplicates of every row, named by its smallest id.

    Two texts are linked if the weighted Jaccard similarity of their ``size``-word shingles
    (words ``[^\\x20\\x09-\\x0D]+``, weight: how often a shingle occurs) is at least ``threshold``;
    groups are the connected components. Texts of equal words are one vertex. Others meet
    where a band agrees, which two texts at 0.8 miss with probability 3e-6.

    Buckets of equal members count once. The members of a bucket are first compared with its pivot
    only, the member that shares most buckets. That settles most buckets: all members are of one class.
    In others of up to ``SMALL`` members (``MEDIUM`` after the first round) all pairs of different classes are compared. In larger
    ones two members x, y that are not linked through the pivot p can be similar in two ways.
    Either what they share with p is enough; these pairs are found by an inequality over sizes and
    compared. Or they share something beyond p; then they meet in a new, smaller bucket (p, shingle).
    Rounds end when no bucket holds two classes. No pair of texts that a band brought together is
    left undecided, and a group of n copies costs about n comparisons, not n * n.

    Texts without words (null, empty) are groups of their own, and so are rows without an
    id (``class_id`` null). Rows that share an id are one document and share a class. An
    empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.filter("doc_id is not null")
    sketches = stored(sketch(known, size, bands, rows), "dart-sketches")
    leads = sketches.groupBy("c1", "c2").agg(F.min("doc_id").alias("lead"), F.min_by("bands", "doc_id").alias("bands"))
    n_rows = sketches.count()
    leads = stored(narrowed(leads, n_rows), "dart-leads")
    member = sketches.select("doc_id", "c1", "c2").join(leads.drop("bands"), ["c1", "c2"]).select(F.col("doc_id").alias("left_id"), F.col("lead").alias("right_id"))
    band_rows = leads.select("lead", F.posexplode("bands").alias("band", "h"))
    # a band hash is 64 bits; the band is mixed in, so one long is the bucket
    band_rows = band_rows.select("lead", F.xxhash64("band", "h").alias("bucket"))
    shared = band_rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    active = stored(band_rows.join(shared, "bucket"), "dart-buckets")
    # rows that share an id are one document: their texts are linked
    label = leads.select("lead", F.col("lead").alias("class"))
    if sketches.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").count():
        same = member.withColumn("first", F.min("right_id").over(Window.partitionBy("left_id"))).filter("first <> right_id")
        label = _relabel(label.distinct(), same.select(F.col("first").alias("left_id"), "right_id"), n_rows, n_rows)
    weight = active.groupBy("lead").agg(F.sum("n").alias("weight"))
    members = active.join(weight, "lead").join(label, "lead").select("bucket", "lead", "weight", F.lit(True).alias("of band"), "class")
    n_members = active.count()
    members = stored(narrowed(members, n_members), "dart-members")
    direct, tested, pool, share, step = None, None, known, threshold / (1 + threshold), 0
    while True:
        best = F.max_by(F.struct("lead", "class"), F.struct("weight", -F.col("lead"))).alias("p")
        parity = [F.bit_xor(F.xxhash64("lead", F.lit(k))).alias(f"h{k}") for k in range(2)]
        sets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"), best, *parity).filter("a < b")
        sets = sets.groupBy("n", "h0", "h1").agg(F.min(F.struct("bucket", "p")).alias("one")).select("n", "one.bucket", "one.p")
        sets = stored(narrowed(sets.select("bucket", "n", F.col("p.lead").alias("pivot")), n_members), "dart-sets")
        held = members.join(sets, "bucket").select("bucket", "lead", "weight", "class", "n", "pivot")
        held = stored(narrowed(held, n_members), "dart-held")
        n_held = held.count()
        limit = SMALL if tested is None else MEDIUM
        small, large = held.filter(F.col("n") <= limit), held.filter(F.col("n") > limit)
        if tested is None:
            pairs = small.filter("lead <> pivot").select(F.least("pivot", "lead").alias("left_id"), F.greatest("pivot", "lead").alias("right_id"))
        else:
            some = small.select("bucket", "lead", "class")
            other = some.select("bucket", F.col("lead").alias("right_id"), F.col("class").alias("other"))
            pairs = some.join(other, "bucket").filter("lead < right_id and class <> other").select(F.col("lead").alias("left_id"), "right_id")
            pairs = pairs.unionByName(direct)
        # large buckets: overlapping ones are one group in the first two rounds; from then on they only shrink
        step += 1
        if step <= 2:
            stars = _joined_groups(stored(narrowed(large.select("pivot", "lead").distinct(), n_held), "dart-large"))
        else:
            stars = large.select(F.col("bucket").alias("group"), F.col("pivot").alias("left_id"), F.col("lead").alias("right_id"))
        stars = stored(narrowed(stars.filter("left_id <> right_id").distinct(), n_held), "dart-stars")
        n_stars = stars.count()
        pairs = pairs.withColumn("wide", F.lit(False)).unionByName(stars.select("left_id", "right_id").withColumn("wide", F.lit(True)))
        pairs = pairs.groupBy("left_id", "right_id").agg(F.max("wide").alias("wide"))
        if tested is None:
            pairs = narrowed(pairs, n_held)
        else:
            once = (F.col("left_id") == F.col("tested_left")) & (F.col("right_id") == F.col("tested_right")) & ~F.col("wide")
            pairs = pairs.join(tested, once, "left_anti")
        pairs = stored(pairs, "dart-pairs")
        n_pairs = pairs.count()
        if not n_pairs:
            break
        left = pool.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"))
        right = pool.select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"))
        # the pairs of all texts grow with the texts: one plan for tables of any size
        known_pairs = pairs.hint("merge") if pool is known else pairs
        texts_of_pairs = narrowed(known_pairs.join(left, "left_id").join(right, "right_id"), n_pairs, WIDE_PART)
        checked = stored(similarity(texts_of_pairs, size, threshold), "dart-compared")
        label = _relabel(label, checked.filter(F.col("similarity") >= threshold).select("left_id", "right_id"), n_rows, n_pairs)
        done = checked.select(F.least("left_id", "right_id").alias("tested_left"), F.greatest("left_id", "right_id").alias("tested_right"))
        if tested is None:
            tested, rest = done, small.select("bucket", "lead", "weight", F.lit(True).alias("of band"))
        else:
            tested, rest = tested.unionByName(done), None  # all pairs of small buckets are decided
            if not n_stars:
                break
        # what is left of a pivot's group: members of two or more classes
        around = checked.filter("wide")
        around = around.withColumn("group", F.col("left_id")) if step <= 2 else around.join(stars, ["left_id", "right_id"])
        around = around.join(label.withColumnRenamed("lead", "right_id"), "right_id")
        is_near = F.col("similarity") >= threshold
        # the most that a member of a size shares with the pivot: any member, and one that isn't linked to it; sizes are numbers of words, so there are few
        most = around.groupBy("group", "size").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.max(F.when(is_near, F.col("class"))).alias("own"), F.max("shared").alias("any"), F.max(F.when(~is_near, F.col("shared"))).alias("far"))
        most = most.groupBy("group").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("own").alias("own"), F.collect_list(F.struct("size", "any", "far")).alias("most")).filter("a < b")
        around = around.join(most.select("group", "own", "most"), "group")
        # what a similar member of another class must at least share beyond the pivot; members of the pivot's class look for those not linked to it
        partners = F.transform("most", lambda z: F.struct(z["size"].alias("size"), F.when(F.col("class") == F.col("own"), z["far"]).otherwise(z["any"]).alias("shared")))
        partners = F.filter(partners, lambda z: z["shared"].isNotNull() & (z["size"] >= threshold * F.col("size") - 1e-6) & (z["size"] * threshold <= F.col("size") + 1e-6))
        needed = F.array_min(F.transform(partners, lambda z: F.ceil(share * (F.col("size") + z["size"]) - 1e-6) - F.least(F.col("shared"), z["shared"])))
        around = around.withColumn("needed", needed).drop("most", "own").filter("needed is not null")
        around = stored(narrowed(around, n_stars, WIDE_PART), "dart-groups")
        left_over = F.transform(F.filter("novel", lambda e: e["rest"] >= F.greatest(F.lit(1), F.col("needed"))), lambda e: e["s"])
        beyond = around.select(F.explode(left_over).alias("s"), "group", "right_id", F.col("shared").alias("weight"))
        beyond = stored(beyond.select(F.xxhash64("group", "s").alias("bucket"), F.col("right_id").alias("lead"), "weight"), "dart-beyond")
        again = beyond.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        members = beyond.join(again, "bucket").withColumn("of band", F.lit(False))
        members = (members if rest is None else members.unionByName(rest)).join(label, "lead")
        n_members = beyond.count() + n_held
        members = stored(narrowed(members, n_members), "dart-members")
        # pairs for which the part shared with the pivot is enough
        near = around.filter(F.col("similarity") < threshold).filter("needed <= 0")
        x = near.select("group", F.col("right_id").alias("x"), F.col("class").alias("x_class"), F.col("shared").alias("x_shared"), F.col("size").alias("x_size"))
        y = around.select("group", F.col("right_id").alias("y"), F.col("class").alias("y_class"), F.col("shared").alias("y_shared"), F.col("size").alias("y_size"))
        enough = (F.col("x_class") != F.col("y_class")) & (F.least("x_shared", "y_shared") >= share * (F.col("x_size") + F.col("y_size")) - 1e-6)
        direct = x.join(y, "group").filter(enough).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
        if pool is known:
            mixed_sets = members.filter("`of band`").withColumn("low", F.min("class").over(Window.partitionBy("bucket"))).withColumn("high", F.max("class").over(Window.partitionBy("bucket")))
            needed = around.select(F.col("right_id").alias("doc_id")).unionByName(mixed_sets.filter("low < high").select(F.col("lead").alias("doc_id"))).distinct()
            pool = stored(known.join(needed, "doc_id", "left_semi"), "dart-texts")
    lead_class = member.join(label, F.col("right_id") == F.col("lead"), "left").select(F.col("left_id").alias("doc_id"), F.coalesce("class", "right_id").alias("class_id"))
    classes = lead_class.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return texts.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
