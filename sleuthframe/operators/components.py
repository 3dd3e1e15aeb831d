"""Connected components of an edge table.

Alternating large-star / small-star rounds (Kiveris et al., 2014). Every round is a min per node plus an
equi-join whose other side has one row per node, so a node with very many neighbours is pre-aggregated before
the shuffle and can be split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in ``edges(src, dst)``; the label is the smallest node."""
    state = cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = _signature(state)
    while before[0] > 0:
        state = cut_lineage(_small_star(_large_star(state)))
        after = _signature(state)
        if after == before:
            break
        before = after
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
