"""Connected components by randomised contraction.

Every round each vertex points to the neighbour (or itself) with the smallest
random priority, pointers are followed once more, and the edges are rewritten to
the vertices pointed at. A constant fraction of the vertices disappears per round,
whatever the shape of the graph, so long chains cost O(log n) rounds and the data
shrinks geometrically. Priorities are drawn anew every second round: after the first
one the hub of a star is its smallest vertex, and with the same priorities the second
one takes all that is left of it. A hub is only ever reduced by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import narrowed, stored


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(id)`` and ``edges(left_id, right_id)`` -> ``(id, component)``.

    ``component`` is the smallest id of the component.
    """
    links = edges.filter("left_id <> right_id").select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    links = stored(links.distinct(), "links")
    labelled = contracted(links, links.count())
    return vertices.select("id").join(labelled, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def contracted(links: DataFrame, n: int) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``: ``n`` rows, ``a < b``, each pair once, cheap to read again."""
    labels, turn = links.select(F.col("a").alias("id"), F.col("a").alias("root")), 0
    while n:

        def drawn(vertex: str, seed: int = turn // 2) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), F.col(vertex)).alias("h"), F.col(vertex).alias("v"))

        ends = [F.struct(F.col(x).alias("from"), F.col(y).alias("near")) for x, y in (("a", "b"), ("b", "a"))]
        both = links.select(F.explode(F.array(*ends)).alias("end")).select("end.*")
        nearest = both.groupBy("from").agg(F.least(F.min(drawn("near")), F.min(drawn("from")))["v"].alias("p"))
        step = nearest.select(F.col("from").alias("v"), F.col("p").alias("first"))
        second = nearest.select(F.col("from").alias("first"), F.col("p").alias("to"))
        jump = stored(narrowed(step.join(second, "first").select("v", "to"), 2 * n), "jumps")
        renamed = (
            links.join(jump.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a")
            .join(jump.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
            .filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        links = stored(narrowed(renamed, n), "links")
        n = links.count()
        if turn == 0:
            labels = jump.select(F.col("v").alias("id"), F.col("to").alias("root"))
        else:
            labels = labels.join(jump.select(F.col("v").alias("root"), "to"), "root", "left").select(
                "id", F.coalesce("to", "root").alias("root")
            )
        turn += 1
        if turn % 4 == 0:  # keep the plan of the composed labels short
            labels = stored(labels, "labels")
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(smallest, "root").select("id", "component")
