"""Exact nearest centroids under the 6-mer profile distance, by pivots and the triangle inequality.

Profiles are count vectors, so their Euclidean distance is a metric. Some centroids of a partition are
pivots; every centroid belongs to the cell of its nearest pivot, and a cell knows how far its members
lie from the pivot. A query is compared with the pivots of its partition first. Its nearest pivot gives an upper
bound, each cell a lower bound:

    distance to any member of cell c  >=  d(query, pivot c) - outermost member of c
                                      >=  innermost member of c - d(query, pivot c)
                                      >=  (d(query, pivot c) - d(query, nearest pivot)) / 2

The nearest cell is searched, and then only cells whose lower bound does not exceed the best distance found. Everything
meets in blocks of bounded size: a block of queries and a block of centroids of one cell are one row, whose
distances are one matrix product, and of which one best centroid per query leaves. Partitions of any size are thus
spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sampling import first_per_group

KMER = 6
SIZE = 4**KMER
#: Queries and centroids of one block.
BLOCK = 512
#: Pivots of a partition: the square root of its centroids, at most one block.
SLACK = 1e-9
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in "CGT"]] = 1, 2, 3
MEMBER = "array<struct<id:bigint,seq:string,count:bigint>>"


def profiles(sequences: pa.Array) -> np.ndarray:
    """6-mer counts of each sequence, one row of 4,096 numbers each."""
    flat = sequences.cast(pa.large_binary())
    n = len(flat)
    if not n:
        return np.zeros((0, SIZE))
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) < KMER:
        return np.zeros((n, SIZE))
    codes = np.zeros(len(data) - KMER + 1, np.int64)
    for k in range(KMER):
        codes = codes * 4 + _CODE[data[k : k + len(codes)]]
    row = np.repeat(np.arange(n), np.diff(offsets))
    whole = np.flatnonzero(row[: len(codes)] == row[KMER - 1 :])  # windows inside one sequence
    return np.bincount(row[whole] * SIZE + codes[whole], minlength=n * SIZE).reshape(n, SIZE).astype(float)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b``: counts are small integers."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _members(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = value.values
    return rows.field("id").to_numpy(), profiles(rows.field("seq")), rows.field("count").to_numpy()


def _blocks(rows: DataFrame, group: list[str], name: str, total: DataFrame | None = None) -> DataFrame:
    """Rows ``id, seq, count`` of each group as arrays of about ``BLOCK`` members: ``group, name``."""
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("members")) if total is None else total
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).alias("block")
    placed = rows.join(total, group).select(*group, block, F.struct("id", "seq", F.col("count").cast("bigint").alias("count")).alias("member"))
    return placed.groupBy(*group, "block").agg(F.collect_list("member").alias(name)).drop("block")


def _nearest(order_squared: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Column of the best centroid of each row: least squared distance, largest count, least id."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, -count))] = np.arange(len(ids))
    least = order_squared.min(axis=1)
    return np.where(order_squared == least[:, None], rank[None, :], len(ids)).argmin(axis=1)


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min_by(F.struct("target", "squared", "count"), F.struct("squared", -F.col("count"), "target")).alias("b")).select("id", "b.*")


def nearest_centroids(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """``id, target, squared`` and ``compared``: the nearest centroid of each query within its partition.

    ``queries`` has ``id, part, seq`` (ACGT), ``centroids`` also ``count``; equally near centroids are decided by the larger
    count, then the smaller id. ``compared`` is the number of centroids the query was measured against, pivots
    included. Queries of a partition without centroids are left out.
    """
    sizes = centroids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    limit = min(BLOCK, max(1, math.ceil(math.sqrt(most))))
    salted = centroids.select("part", "id", "seq", "count")
    leading = first_per_group(salted, ["part"], [F.xxhash64("id"), F.col("id")], limit, "id").join(sizes, "part")
    pivots = cut(leading.filter(F.col("nth") <= F.ceil(F.sqrt("n"))).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "seq", F.col("count").cast("bigint").alias("count")))).alias("pivots")))

    def nearest_pivot(batches):
        for batch in batches:
            for own, others in zip(batch.column("members"), batch.column("pivots"), strict=True):
                ids, a, count = _members(own)
                pivot_ids, b, _ = _members(others)
                squared = squared_distances(a, b)
                at = squared.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), own.values.field("seq"), pa.array(count), pa.array(pivot_ids[at]), pa.array(np.sqrt(squared[np.arange(len(at)), at]))], names=["id", "seq", "count", "cell", "away"]
                )

    placed = cut(_blocks(salted, ["part"], "members").join(pivots, "part").select("members", "pivots").mapInArrow(nearest_pivot, "id long, seq string, count long, cell long, away double"))
    cells = cut(placed.groupBy("cell").agg(F.min("away").alias("inner"), F.max("away").alias("outer"), F.count(F.lit(1)).alias("members")))
    bounds = pivots.select("part", F.explode("pivots.id").alias("cell")).join(cells, "cell")
    listed = bounds.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("cell", "inner", "outer", "members"))).alias("cells"))

    def open_cells(batches):
        for batch in batches:
            for own, others, known in zip(*(batch.column(c) for c in ("members", "pivots", "cells")), strict=True):
                ids, a, _ = _members(own)
                pivot_ids, b, _ = _members(others)
                table = known.values
                cell, inner, outer = table.field("cell").to_numpy(), table.field("inner").to_numpy(), table.field("outer").to_numpy()
                away = np.sqrt(squared_distances(a, b))[:, np.searchsorted(pivot_ids, cell)]  # pivots without members of their own have no cell
                first = away.argmin(axis=1)
                near = away[np.arange(len(first)), first][:, None]
                low = np.maximum(np.maximum(away - outer, inner - away), (away - near) / 2)
                low[np.arange(len(first)), first] = 0.0
                query, column = np.nonzero(low <= near + SLACK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), own.values.field("seq").take(pa.array(query)), pa.array(cell[column]), pa.array(low[query, column]), pa.array(column == first[query]), pa.array(np.full(len(query), len(pivot_ids)))],
                    names=["id", "seq", "cell", "low", "first", "pivots"],
                )

    asked = queries.select("part", "id", "seq", F.lit(0).cast("bigint").alias("count"))
    opened = cut(_blocks(asked, ["part"], "members").join(pivots.join(listed, "part"), "part").select("members", "pivots", "cells").mapInArrow(open_cells, "id long, seq string, cell long, low double, first boolean, pivots long"))

    def search(batches):
        for batch in batches:
            for own, others in zip(batch.column("asked"), batch.column("members"), strict=True):
                ids, a, _ = _members(own)
                targets, b, count = _members(others)
                squared = squared_distances(a, b)
                at = _nearest(squared, count, targets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(targets[at]), pa.array(squared[np.arange(len(at)), at].astype(np.int64)), pa.array(count[at]), pa.array(np.full(len(at), len(targets)))],
                    names=["id", "target", "squared", "count", "compared"],
                )

    members = cut(_blocks(placed, ["cell"], "members", cells.select("cell", "members")))

    def searched(rows: DataFrame) -> DataFrame:
        blocks = _blocks(rows.select("cell", "id", "seq", F.lit(0).cast("bigint").alias("count")), ["cell"], "asked")
        return blocks.join(members, "cell").select("asked", "members").mapInArrow(search, "id long, target long, squared long, count long, compared long")

    near = cut(searched(opened.filter("first")))
    best = _best(near)
    rest = opened.filter("NOT first").join(best.select("id", "squared"), "id").filter(F.col("low") <= F.sqrt("squared") + SLACK)
    found = cut(near.unionByName(searched(rest)))
    measured = found.groupBy("id").agg(F.sum("compared").alias("compared")).join(opened.filter("first").select("id", "pivots"), "id")
    return _best(found).select("id", "target", "squared").join(measured.select("id", (F.col("compared") + F.col("pivots")).alias("compared")), "id")


def squared_profile_distance() -> Column:
    """Arrow function of two sequences: the squared distance of their 6-mer profiles."""

    @F.pandas_udf("int")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = np.zeros(len(left), np.int64)
            for begin in range(0, len(left), BLOCK):
                a, b = (profiles(pa.array(s.iloc[begin : begin + BLOCK], pa.string())) for s in (left, right))
                out[begin : begin + BLOCK] = ((a - b) ** 2).sum(axis=1)
            yield pd.Series(out)

    return distance
