"""Newick trees as edge rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_TYPE = "tree_id string, node int, parent int, length double, name string"


def newick_edges(text: str) -> list[tuple[int, int | None, float | None, str]]:
    """(node, parent, length, name) in depth-first order; the root has no parent."""
    out: list[list] = []
    stack: list[int] = []
    position, text = 0, text.strip()
    if not text.startswith("("):
        raise ValueError("Newick text has to open with a parenthesis.")

    def open_node() -> int:
        out.append([len(out), stack[-1] if stack else None, None, ""])
        return len(out) - 1

    def label(at: int) -> tuple[str, int]:
        if at < len(text) and text[at] == "'":
            end, name = at + 1, ""
            while end < len(text):
                if text[end] == "'":
                    if text[end + 1 : end + 2] != "'":
                        return name, end + 1
                    end += 1
                name += text[end]
                end += 1
            raise ValueError("A quoted name in the Newick text has no closing quote.")
        end = at
        while end < len(text) and text[end] not in "(),:;[":
            end += 1
        return text[at:end].strip(), end

    current: int | None = None
    while position < len(text):
        c = text[position]
        if c == "(":
            stack.append(open_node())
            current, position = None, position + 1
        elif c in ",)":
            if current is None:
                open_node()
            if c == ")":
                if not stack:
                    raise ValueError("Opening and closing parentheses of the Newick text do not match.")
                current = stack.pop()
            else:
                current = None
            position += 1
            if c == ")":
                out[current][3], position = label(position)
        elif c == ":":
            end = position + 1
            while end < len(text) and text[end] not in "(),;[":
                end += 1
            out[current][2], position = float(text[position + 1 : end]), end
        elif c == "[":
            position = text.index("]", position) + 1
        elif c == ";":
            break
        elif c.isspace():
            position += 1
        else:
            current = open_node()
            out[current][3], position = label(position)
    if stack:
        raise ValueError("Opening and closing parentheses of the Newick text do not match.")
    return [tuple(row) for row in out]


def parse_newick(trees: DataFrame) -> DataFrame:
    """``(tree_id, newick)`` -> edge rows; a tree is parsed in the task that reads it."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, *edge) for t, text in zip(batch.tree_id, batch.newick, strict=True) for edge in newick_edges(text)]
            frame = pd.DataFrame(rows, columns=["tree_id", "node", "parent", "length", "name"])
            yield frame.astype({"node": "int32", "parent": "Int32", "length": "float64"})

    return trees.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(parse, EDGE_TYPE)


def node_depths(edges: DataFrame) -> DataFrame:
    """Distance of every node from its root, for many trees at once.

    Pointer doubling: each round a node adopts its ancestor's ancestor and adds that
    distance, so a tree of depth d needs log2(d) joins.
    """
    from ..session import cut

    state = cut(edges.select("tree_id", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("depth")))
    while True:
        above = state.select("tree_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = cut(state.join(above, ["tree_id", "up"], "left").select("tree_id", "node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth")))
        if state.filter("up IS NOT NULL").isEmpty():
            break
    return state.select("tree_id", "node", "depth")


def collapse_short_branches(edges: DataFrame, minimum: float) -> DataFrame:
    """Internal branches shorter than ``minimum`` vanish; their children move up.

    A collapsed node points to its parent until a kept node is reached.
    """
    from ..session import cut

    parents = edges.filter("parent IS NOT NULL").select("tree_id", F.col("parent").alias("node")).distinct()
    inner = edges.join(parents.withColumn("inner", F.lit(True)), ["tree_id", "node"], "left")
    short = F.col("inner") & F.col("parent").isNotNull() & (F.coalesce("length", F.lit(0.0)) < minimum)
    gone = cut(inner.filter(short).select("tree_id", "node", F.col("parent").alias("to")))
    kept = edges.join(gone.select("tree_id", "node"), ["tree_id", "node"], "left_anti")
    target = gone
    while True:
        chained = target.join(gone.select("tree_id", F.col("node").alias("to"), F.col("to").alias("next")), ["tree_id", "to"], "left")
        if chained.filter("next IS NOT NULL").isEmpty():
            break
        target = cut(chained.select("tree_id", "node", F.coalesce("next", "to").alias("to")))
    moved = target.select("tree_id", F.col("node").alias("parent"), "to")
    return kept.join(moved, ["tree_id", "parent"], "left").select("tree_id", "node", F.coalesce("to", "parent").alias("parent"), "length", "name")
