"""Connected components by contraction.

Each node hooks to its smallest neighbour, edges move to the nodes hooked to, and edges inside one node vanish. A round
is one minimum per node, combined before the shuffle, and two joins of the remaining edges with one row per node. The
smallest node of a component never hooks elsewhere, so it is its label in the end.

A round writes the edges that are left, as Parquet, and nothing else: the next round reads them by a plain scan, and labels
come from all rounds' edges in one last job. So the driver keeps a file list per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import settle, stored


def _hooks(edges: DataFrame) -> DataFrame:
    """(node, up): the smallest of each node and its neighbours."""
    ways = F.explode(
        F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("to")),
        )
    ).alias("way")
    hook = edges.select(ways).groupBy(F.col("way.node").alias("node")).agg(F.min("way.to").alias("up"))
    return hook.select("node", F.least("node", "up").alias("up"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, name) for every node of ``edges(a, b)`` with whole-number nodes."""
    edges = stored(edges.select("a", "b").where("a <> b"), "edges")
    rounds = []
    while not edges.isEmpty():
        hook = _hooks(edges)
        rounds.append(hook)
        one = hook.select(F.col("node").alias("a"), F.col("up").alias("new_a"))
        two = hook.select(F.col("node").alias("b"), F.col("up").alias("new_b"))
        moved = edges.join(one, "a").join(two, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias(name))
    labels = rounds[0].withColumnRenamed("up", name)
    for hook in rounds[1:]:
        later = hook.withColumnRenamed("node", name)
        labels = labels.join(later, name, "left").select("node", F.coalesce("up", name).alias(name))
    return settle(labels)
