"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for each node of an edge.

    Every round points each node at its smallest neighbour, follows the pointers
    to their roots and contracts the edges to these, which at least halves the
    nodes of every component that isn't done; following doubles its step each
    time. So the work grows with logarithms of the nodes and the longest path.
    Self-loops and repeated edges have no effect; no edges give no rows. Nothing is collected: each round asks only whether edges are left.
    """
    edges = written(edges.where("a != b").select("a", "b").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")))
        while True:
            onward = pointer.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = written(pointer.join(onward, "to").select("node", "to", "further"))
            discard(pointer)
            done = jumped.where("further != to").isEmpty()
            pointer = written(jumped.select("node", F.col("further").alias("to")))
            discard(jumped)
            if done:
                break
        maps.append(pointer)
        near = pointer.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        far = pointer.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        left = written(edges.join(near, "a").join(far, "b").where("a2 != b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
        discard(edges)
        edges = left
    found = maps[0].select("node", F.col("to").alias("component")) if maps else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for pointer in maps[1:]:
        step = pointer.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = written(found)
    discard(edges, *maps)
    return out
