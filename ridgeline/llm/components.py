"""Connected components of a graph of document ids, by hooking and pointer jumping.

Every round hooks each root onto its smallest neighbour, flattens the parents and contracts the
edges. All state is in tables of the shared folder; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, component) for every node that has an edge to another; component is the
    smallest node reachable. Loops, repeated edges, nulls and either direction are allowed."""
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a < b").distinct()
    live = stage(live, "edges")
    parent: DataFrame | None = None
    while not live.isEmpty():
        hooks = flatten(stage(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks"))
        if parent is None:
            grown = hooks
        else:
            moved = parent.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            grown = stage(moved.unionByName(hooks), "parents")
            unstage(parent)
        old, live = live, stage(contract(live, hooks), "edges")
        unstage(old)
        if parent is not None:
            unstage(hooks)
        parent = grown
    unstage(live)
    if parent is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    roots = parent.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    return parent.select("node", F.col("root").alias("component")).unionByName(roots)


def flatten(pointers: DataFrame) -> DataFrame:
    """Jump pointers until each leads to a root (a node that points nowhere)."""
    while True:
        nxt = pointers.select(F.col("node").alias("root"), F.col("root").alias("to"))
        jumped = stage(pointers.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "hooks")
        unstage(pointers)
        moved = not jumped.where("moved").isEmpty()
        path = jumped.ridgeline_path
        pointers = jumped.select("node", "root")
        pointers.ridgeline_path = path
        if not moved:
            return pointers


def contract(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """Edges between roots after hooking."""
    to_a, to_b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"{x}_to")) for x in "ab")
    moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
