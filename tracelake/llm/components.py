"""Connected components over edges in a table, by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut

#: Least labels double their reach with each round; 2^40 nodes in a path take 40.
MAX_ROUNDS = 60


def min_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label of each node's component: columns ``node`` and ``label``.

    ``edges``: (a, b), either way round, repeats and loops allowed. ``labels``: (node, label), a row a
    node. Only nodes of edges are returned. The rounds alternate two steps on a star-shaped graph:
    every node hangs itself on the least node that it or a neighbour hangs on (large star), then on
    where that one hangs (small star). Each round groups by node with partial aggregation, so a node
    of very many edges doesn't land in one task. Aggregates that join back are written to the shared
    folder first: both sides of those joins are then plain scans, whose hot keys AQE splits.
    """
    both = edges.where("a <> b")
    graph = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if graph.isEmpty():
        return labels.where("false").select("node", "label")
    nodes = None
    for _ in range(MAX_ROUNDS):
        # large star: neighbours larger than u go to the least of u and its neighbours
        sides = graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = cut(small)
        # done when the edges are stars: nothing has moved
        before, after = (g.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for g in (graph, new))
        graph = new
        if (before["n"], before["h"]) == (after["n"], after["h"]):
            nodes = graph
            break
    if nodes is None:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    member = nodes.select(F.col("u").alias("node"), F.col("v").alias("root")).union(nodes.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    known = member.join(labels, "node")
    root_label = cut(known.groupBy("root").agg(F.min("label").alias("label")))
    return member.join(root_label, "root").select("node", "label")
