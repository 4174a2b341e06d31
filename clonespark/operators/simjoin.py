"""Exact similarity joins that stay near-linear under skew.

Two strings within ``d`` differences must agree on at least one of ``d + 1`` blocks,
so a similarity join is an equi-join on (partition, length, block number, block)
followed by verification. Real repertoires break the plain scheme: a conserved
block, such as the J end of a CDR3, is shared by most of a partition and its
bucket is quadratic.

Buckets are therefore sized first. Rows of a bucket above ``hot_group`` do not meet
there; the block they share is removed and the rule is applied again to what is
left of the sequence, where again at least one of ``d + 1`` blocks must agree. The
key grows by one block per level, so a hot bucket splits until its parts are cold
or until no more than ``d`` symbols remain, at which point every pair in the bucket
matches by construction. No pair is lost and nothing is capped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import edit_distances
from ..functions.sequences import PACK_WIDTH, blocks, packed_hamming, packed_words
from ..session import cut

# A bucket may pair at most this many rows with as many others.
HOT_GROUP = 2048


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _hamming_keys(frame: DataFrame) -> DataFrame:
    """One row per block of ``rest``; ``key`` names the blocks agreed on so far."""
    count = F.greatest(F.lit(1), F.least(F.length("rest"), F.col("lim") + 1)).cast("int")
    keyed = frame.withColumn("n", count).select("*", F.posexplode(blocks("rest", F.col("n"))).alias("b", "value"))
    return keyed.withColumn("key", F.concat_ws("|", "path", F.col("b").cast("string"), "value"))


def _drop_block(keyed: DataFrame) -> DataFrame:
    start = F.floor(F.col("b") * F.length("rest") / F.col("n")).cast("int")
    stop = F.floor((F.col("b") + 1) * F.length("rest") / F.col("n")).cast("int")
    rest = F.concat(F.substring("rest", F.lit(1), start), F.substring("rest", stop + 1, F.length("rest")))
    return keyed.withColumn("rest", rest).withColumn("path", F.col("key")).drop("n", "b", "value", "key")


def _hot_keys(left: DataFrame, right: DataFrame | None, hot_group: int) -> DataFrame | None:
    """Buckets too large to pair inside, or None when there are none."""
    sizes = left.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    if right is None:
        hot = sizes.filter(F.col("size") > hot_group)
    else:
        # a bucket is small when either side, times the other, stays in bounds
        other = right.groupBy("part", "key").agg(F.count(F.lit(1)).alias("other"))
        hot = sizes.join(other, ["part", "key"]).filter(F.col("size") * F.col("other") > hot_group * hot_group)
    hot = hot.select("part", "key")
    # most inputs have no hot bucket: look for one before materialising them
    return None if hot.isEmpty() else cut(hot)


def _alias(frame: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"{prefix}{c}") for c in keep])


def _verified(left: DataFrame, right: DataFrame, key: str, keep: list[str], distance: Column, extra: Column | None) -> DataFrame:
    a, b = _alias(left, "l_", ["part", key, *keep]), _alias(right, "r_", ["part", key, *keep])
    condition = (F.col("l_part") == F.col("r_part")) & (F.col(f"l_{key}") == F.col(f"r_{key}"))
    if extra is not None:
        condition = condition & extra
    joined = a.join(b, condition).withColumn("distance", distance.cast("int"))
    within = (F.col("distance") >= 0) & (F.col("distance") <= F.col("l_lim"))
    return joined.filter(within).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "distance")


#: Columns with the numbers of these letters in a text.
NUMBERS = {f"n_{c}": c for c in "ACGT"}


def _numbered(frame: DataFrame) -> DataFrame:
    return frame.withColumns({name: F.length("seq") - F.length(F.translate("seq", letter, "")) for name, letter in NUMBERS.items()})


#: Candidate pairs measured at once.
MEASURED = 8192


def _measured(left: DataFrame, right: DataFrame, extra: Column | None) -> DataFrame:
    """Pairs of equal ``part`` and ``key`` whose edit distance is within ``lim`` of the left row, measured many at once.

    An edit changes the numbers of two letters by one at most, so pairs whose numbers differ by more are not measured.
    """
    a, b = _alias(left, "l_", left.columns), _alias(right, "r_", right.columns)
    condition = (F.col("l_part") == F.col("r_part")) & (F.col("l_key") == F.col("r_key")) & (F.col("l_path") == F.col("r_path"))
    unlike = sum((F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) for c in NUMBERS), F.lit(0))
    condition = condition & (unlike <= 2 * F.col("l_lim"))
    if extra is not None:
        condition = condition & extra

    def measure(batches):
        for batch in batches:
            for low in range(0, len(batch), MEASURED):
                rows = batch.slice(low, MEASURED)
                found = edit_distances(rows.column("l_seq"), rows.column("r_seq"), rows.column("l_lim").to_numpy().astype(np.int64))
                kept = np.flatnonzero(found >= 0)
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("l_id").take(at), rows.column("r_id").take(at), pa.array(found[kept].astype(np.int32))], names=["left_id", "right_id", "distance"]
                )

    left_id, right_id = (side.schema["id"].dataType.simpleString() for side in (left, right))
    candidates = a.join(b, condition).select("l_id", "r_id", "l_lim", "l_seq", "r_seq")
    return candidates.mapInArrow(measure, f"left_id {left_id}, right_id {right_id}, distance int")


def _carried(words: int) -> list[str]:
    return ["id", "lim", *[f"w{i}" for i in range(words)]]


def _packed(nodes: DataFrame, words: int) -> DataFrame:
    columns = [F.col("id"), F.col("part"), F.col("lim").cast("int").alias("lim"), F.col("seq")]
    columns += [w.alias(f"w{i}") for i, w in enumerate(packed_words("seq", words))]
    return nodes.select(*columns).select(
        "*", F.col("seq").alias("rest"), F.length("seq").cast("string").alias("path")
    ).drop("seq")


def _packed_distance(words: int) -> Column:
    return packed_hamming([F.col(f"l_w{i}") for i in range(words)], [F.col(f"r_w{i}") for i in range(words)])


def hamming_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    hot_group: int = HOT_GROUP,
    links_only: bool = False,
) -> DataFrame:
    """Pairs of equal-length nucleotide sequences within ``lim`` mismatches.

    Inputs carry ``id``, ``part`` (pairs never cross it), ``seq`` (ACGTN, N being an
    ordinary symbol) and ``lim``, which must depend on the length alone. Without
    ``right`` the join is on itself and returns each pair once, smaller id first.
    With ``links_only`` the result suffices for connected components: a bucket whose
    members all match is returned as links to its smallest id, not as all pairs.
    Result: ``left_id, right_id, distance`` (distance NULL for such links).
    """
    own = right is None
    sides = left.select("seq") if own else left.select("seq").union(right.select("seq"))
    words = -(-(sides.agg(F.max(F.length("seq"))).first()[0] or 1) // PACK_WIDTH)
    keep = _carried(words)
    distance = _packed_distance(words)
    extra = (F.col("l_id") < F.col("r_id")) if own else None
    frame_l = _packed(left, words)
    frame_r = None if own else _packed(right, words)
    found: list[DataFrame] = []
    while True:
        keyed_l = _hamming_keys(frame_l)
        keyed_r = None if own else _hamming_keys(frame_r)
        hot = _hot_keys(keyed_l, keyed_r, hot_group)
        if hot is None:
            found.append(_verified(keyed_l, keyed_l if own else keyed_r, "key", keep, distance, extra))
            break
        cold_l = keyed_l.join(hot, ["part", "key"], "left_anti")
        cold_r = cold_l if own else keyed_r.join(hot, ["part", "key"], "left_anti")
        found.append(_verified(cold_l, cold_r, "key", keep, distance, extra))

        frame_l = cut(_drop_block(keyed_l.join(hot, ["part", "key"], "left_semi")))
        frame_r = None if own else cut(_drop_block(keyed_r.join(hot, ["part", "key"], "left_semi")))
        closed = F.length("rest") <= F.col("lim")
        done_l = frame_l.filter(closed)
        if own and links_only:
            first = done_l.groupBy("part", "path").agg(F.min("id").alias("left_id"))
            found.append(
                done_l.join(first, ["part", "path"])
                .filter(F.col("id") != F.col("left_id"))
                .select("left_id", F.col("id").alias("right_id"), F.lit(None).cast("int").alias("distance"))
            )
        else:
            done_r = done_l if own else frame_r.filter(closed)
            found.append(_verified(done_l, done_r, "path", keep, distance, extra))
        frame_l = frame_l.filter(~closed)
        frame_r = None if own else frame_r.filter(~closed)
    pairs = _union(found)
    return pairs if links_only else pairs.dropDuplicates(["left_id", "right_id"])


def _segment_key(*agreed: Column) -> Column:
    """Bucket of what two rows agree on, as a number. Rows of one path that fall together by chance are measured and told apart."""
    return F.xxhash64("path", *agreed)


def _indexed_segments(frame: DataFrame) -> DataFrame:
    """Indexed side of the edit join: ``lim + 1`` segments, or one key if too short."""
    length = F.length("rest")
    long = length > F.col("lim")
    keyed = frame.withColumn("n", F.when(long, F.col("lim") + 1).otherwise(1)).select(
        "*", F.posexplode(blocks("rest", F.col("n"))).alias("b", "value")
    )
    start = F.floor(F.col("b") * length / F.col("n")).cast("int")
    return (
        keyed.withColumn("short", length <= F.col("lim"))
        .withColumn("start", start)
        .withColumn("span", F.length("value"))
        .withColumn("key", F.when(F.col("short"), _segment_key(F.lit("short"))).otherwise(_segment_key(F.col("b"), F.col("value"))))
        .drop("n", "value")
    )


def _probing_segments(frame: DataFrame) -> DataFrame:
    """Probing side: every placement of each indexed segment that an alignment within ``lim`` edits can need.

    Of ``lim + 1`` segments and at most ``lim`` edits some segment ``b`` (from 0) is free of edits and has exactly ``b``
    edits before it: the edits up to a segment less the segments so far start at 0, fall by at most one a
    segment and end below 0. At most ``lim - b`` edits then lie behind it, so that it is shifted by at most
    ``b`` from the front and by at most ``lim - b`` from the back.
    """
    n = F.col("lim") + 1
    spans = F.transform(
        F.sequence(F.lit(0), F.col("lim")),
        lambda b: F.struct(
            b.alias("b"),
            F.floor(b * F.col("rlen") / n).cast("int").alias("start"),
            (F.floor((b + 1) * F.col("rlen") / n) - F.floor(b * F.col("rlen") / n)).cast("int").alias("span"),
        ),
    )
    short = frame.filter(F.col("rlen") <= F.col("lim")).select(
        "*",
        F.lit(True).alias("short"),
        F.lit(0).alias("start"),
        F.lit(0).alias("span"),
        _segment_key(F.lit("short")).alias("key"),
    )
    seg = frame.filter(F.col("rlen") > F.col("lim")).select("*", F.explode(spans).alias("s"))
    before, behind = F.col("s.b"), F.col("lim") - F.col("s.b")
    from_back = F.col("s.start") + F.length("rest") - F.col("rlen")
    first = F.greatest(F.lit(0), F.col("s.start") - before, from_back - behind)
    last = F.least(F.length("rest") - F.col("s.span"), F.col("s.start") + before, from_back + behind)
    placed = seg.filter(last >= first).select("*", F.explode(F.sequence(first, last)).alias("at"))
    value = F.substring("rest", F.col("at") + 1, F.col("s.span"))
    long = placed.select(
        *frame.columns,
        F.lit(False).alias("short"),
        F.col("at").alias("start"),
        F.col("s.span").alias("span"),
        _segment_key(F.col("s.b"), value).alias("key"),
    )
    return short.unionByName(long)


def _drop_segment(keyed: DataFrame, probing: bool) -> DataFrame:
    rest = F.concat(
        F.substring("rest", F.lit(1), F.col("start")),
        F.substring("rest", F.col("start") + F.col("span") + 1, F.length("rest")),
    )
    out = keyed.withColumn("rest", rest).withColumn("path", F.concat_ws("|", F.substring_index("path", "|", 1), F.col("key").cast("string")))
    if probing:
        out = out.withColumn("rlen", F.col("rlen") - F.col("span"))
    return out.drop("b", "start", "span", "key", "short").dropDuplicates(["id", "part", "path", "rest", "lim", *(["rlen"] if probing else [])])


def edit_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    limit: int | None = None,
    identity: float | None = None,
    hot_group: int = HOT_GROUP,
    above: str | None = None,
) -> DataFrame:
    """Pairs within a Levenshtein limit; ``right`` is indexed, ``left`` probes it.

    The limit is either a constant or ``floor((1 - identity) * longer length)``.
    Inputs carry ``id``, ``part`` and ``seq``; result ``left_id, right_id, distance``.
    With ``above``, a number both inputs carry, only pairs whose right row has more of it are measured.
    """
    left, right = _numbered(left), _numbered(right)
    carried = [*NUMBERS, *([] if above is None else [above])]
    if (limit is None) == (identity is None):
        raise ValueError("give either a limit or an identity")
    r_len, l_len = F.length("seq"), F.length("seq")
    if limit is not None:
        lims = F.array(F.lit(limit))
        lengths = F.sequence(F.greatest(F.lit(1), l_len - limit), l_len + limit)

        def lim_of(_: Column) -> Column:
            return F.lit(limit)
    else:
        if identity <= 0:
            raise ValueError("the identity must be above zero")
        slack = 1 - identity
        low = F.floor(slack * r_len + 1e-9).cast("int")
        high = F.floor(slack * r_len / identity + 1e-9).cast("int") + 1
        lims = F.sequence(low, high)
        lengths = F.sequence(
            F.greatest(F.lit(1), F.floor(l_len * identity - 1e-9).cast("int")), F.ceil(l_len / identity + 1e-9).cast("int")
        )

        def lim_of(other: Column) -> Column:
            return F.floor(slack * F.greatest(l_len, other) + 1e-9).cast("int")

    frame_r = right.select("id", "part", F.explode(lims).alias("lim"), "seq", *carried).select(
        "*", F.col("seq").alias("rest"), F.concat_ws("~", F.length("seq").cast("string"), F.col("lim").cast("string")).alias("path")
    )
    frame_l = (
        left.select("id", "part", "seq", *carried, F.explode(lengths).alias("rlen"))
        .withColumn("lim", lim_of(F.col("rlen")))
        .filter(F.abs(F.length("seq") - F.col("rlen")) <= F.col("lim"))
        .select("*", F.col("seq").alias("rest"), F.concat_ws("~", F.col("rlen").cast("string"), F.col("lim").cast("string")).alias("path"))
    )
    wanted = None if above is None else F.col(f"r_{above}") > F.col(f"l_{above}")
    found: list[DataFrame] = []
    while True:
        keyed_l, keyed_r = _probing_segments(frame_l), _indexed_segments(frame_r)
        hot = _hot_keys(keyed_l.filter(~F.col("short")), keyed_r.filter(~F.col("short")), hot_group)
        if hot is None:
            found.append(_measured(keyed_l, keyed_r, wanted))
            break
        hot = hot.withColumn("short", F.lit(False))
        at = ["part", "key", "short"]
        found.append(_measured(keyed_l.join(hot, at, "left_anti"), keyed_r.join(hot, at, "left_anti"), wanted))
        frame_l = cut(_drop_segment(keyed_l.join(hot, at, "left_semi"), True))
        frame_r = cut(_drop_segment(keyed_r.join(hot, at, "left_semi"), False))
    return _union(found).dropDuplicates(["left_id", "right_id"])
