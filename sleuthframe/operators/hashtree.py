"""Merkle tree over the blocks of a hash chain, which shows lost rows and proves single ones.

A chain tells whether the rows that are there fit together; rows lost at the end of a chain, or a segment lost whole, leave
nothing behind that doesn't fit. The tree is kept apart from the rows. Its nodes are numbered by id, not by place: node
``at`` of level 1 covers ``fan`` ids from ``at * fan``, a node of level k covers ``fan`` nodes of the level below. So a lost
or inserted row changes the nodes above it and no others, and the nodes that differ name the ids.

A level is one aggregate over the level below, of bounded groups, and has a ``fan``-th of its rows. The tree is a table
(level, at, n, digest); the digest of its one node of the highest level is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.columns import text
from sleuthframe.session import cut_lineage

FAN = 64


def _digest(level: Column, at: Column, children: Column) -> Column:
    """Digest of a node from ``children``, an array of (key, digest) in order."""
    lines = F.transform(children, lambda c: F.concat(c["key"].cast("string"), F.lit(":"), c["digest"]))
    head = F.concat(level.cast("string"), F.lit(":"), at.cast("string"))
    return F.sha2(F.concat_ws("\n", head, F.concat_ws("\n", lines)), 256)


def leaves(rows: DataFrame) -> DataFrame:
    """(key, digest) of the hashed rows."""
    return rows.where(text("event_hash") != "").select(F.col("id").alias("key"), F.col("event_hash").alias("digest"))


def _above(children: DataFrame, level: int, fan: int, n: Column) -> DataFrame:
    grouped = children.groupBy(F.floor(F.col("key") / F.lit(fan)).cast("bigint").alias("at")).agg(
        F.sum(n).cast("bigint").alias("n"), F.array_sort(F.collect_list(F.struct("key", "digest"))).alias("children")
    )
    return grouped.select(
        F.lit(level).alias("level"), "at", "n", _digest(F.lit(level), F.col("at"), F.col("children")).alias("digest")
    )


def blocks(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of level 1."""
    return _above(leaves(rows), 1, fan, F.lit(1))


def grow(first: DataFrame, fan: int = FAN) -> DataFrame:
    """All levels over the nodes of level 1, up to the root."""
    level = cut_lineage(first)
    out, depth = level, 1
    top = level.agg(F.max("at").alias("top")).first()["top"] or 0
    while top > 0:
        depth, top = depth + 1, top // fan
        children = level.select(F.col("at").alias("key"), "digest", "n")
        level = cut_lineage(_above(children, depth, fan, F.col("n")))
        out = out.unionByName(level)
    return out


def tree(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """The tree over the hashed rows of ``rows(id, event_hash)``."""
    return grow(blocks(rows, fan), fan)


def extend(stored: DataFrame, rows: DataFrame, first_id: int, fan: int = FAN) -> DataFrame:
    """The tree after rows from ``first_id`` on were appended.

    ``rows`` must have all rows from the first id of the block of ``first_id`` on; older ones are not read.
    """
    at = first_id // fan
    old = stored.where((F.col("level") == 1) & (F.col("at") < at))
    return grow(old.unionByName(blocks(rows.where(F.col("id") >= at * fan), fan)), fan)


def root(nodes: DataFrame) -> DataFrame:
    """(level, at, n, digest) of the root; nothing for an empty tree."""
    return nodes.orderBy(F.desc("level"), "at").limit(1)


def differences(stored: DataFrame, now: DataFrame, fan: int = FAN) -> DataFrame:
    """Id ranges of the blocks that are not as stored: first_id, last_id, stored_rows, found_rows, what.

    ``what`` is lost (no row left), shrunk, grown, new (no row stored) or changed.
    """
    one = stored.where("level = 1").select("at", F.col("n").alias("s"), F.col("digest").alias("sd"))
    two = now.where("level = 1").select("at", F.col("n").alias("f"), F.col("digest").alias("fd"))
    both = one.join(two, "at", "full").where(~F.col("sd").eqNullSafe(F.col("fd")))
    s, f = F.coalesce("s", F.lit(0)).cast("bigint"), F.coalesce("f", F.lit(0)).cast("bigint")
    what = (
        F.when(F.col("f").isNull(), "lost").when(F.col("s").isNull(), "new").when(f < s, "shrunk").when(f > s, "grown")
    )
    return both.select(
        (F.col("at") * fan).alias("first_id"),
        ((F.col("at") + 1) * fan - 1).alias("last_id"),
        s.alias("stored_rows"),
        f.alias("found_rows"),
        what.otherwise("changed").alias("what"),
    )


def summary(stored: DataFrame, now: DataFrame, fan: int = FAN) -> DataFrame:
    """One row: whether the roots agree, the blocks that differ and the rows missing from them or added to them."""
    found = differences(stored, now, fan)
    gap = F.col("stored_rows") - F.col("found_rows")
    return found.agg(
        (F.count("*") == 0).alias("root_matches"),
        F.count("*").alias("changed_blocks"),
        F.coalesce(F.sum(F.greatest(gap, F.lit(0))), F.lit(0)).alias("missing_events"),
        F.coalesce(F.sum(F.greatest(-gap, F.lit(0))), F.lit(0)).alias("added_events"),
    )


def paths(nodes: DataFrame, rows: DataFrame, wanted: DataFrame, fan: int = FAN) -> DataFrame:
    """(id, path) for the ids of ``wanted(id)``: per level the node and all its children, from the row's block to the root.

    With the path and the root alone ``proves`` shows that a row was in the tree. A path has at most ``fan`` children per level.
    """
    # Only the blocks that are asked for are read in full, and only the nodes above them are gathered.
    depth = nodes.agg(F.max("level").alias("d")).first()["d"] or 0
    asked = wanted.select("id").distinct()
    at = lambda c, level: F.floor(F.col(c) / F.lit(fan**level)).cast("bigint")
    bottom = leaves(rows).withColumns({"level": F.lit(1), "at": at("key", 1)})
    upper = nodes.where(F.col("level") < depth).select(
        F.col("at").alias("key"), "digest", (F.col("level") + 1).alias("level"), at("at", 1).alias("at")
    )
    spots = asked.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), at("id", k).alias("at")) for k in range(1, depth + 1)])).alias("s"))
    spots = spots.select("id", "s.level", "s.at")
    needed = spots.select("level", "at").distinct()
    gathered = (
        bottom.select("level", "at", "key", "digest")
        .unionByName(upper.select("level", "at", "key", "digest"))
        .join(needed, ["level", "at"], "left_semi")
        .groupBy("level", "at")
        .agg(F.array_sort(F.collect_list(F.struct("key", "digest"))).alias("children"))
    )
    steps = spots.join(gathered, ["level", "at"])
    return steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "at", "children"))).alias("path"))


def proves(row_id: Column, event_hash: Column, path: Column, root_digest: Column, fan: int = FAN) -> Column:
    """Whether a path leads from a row to the root: each node holds the digest below it at the place its number demands."""
    start = F.struct(F.lit(True).alias("ok"), row_id.cast("bigint").alias("key"), event_hash.alias("digest"))

    def climb(acc: Column, node: Column) -> Column:
        holds = F.exists(node["children"], lambda c: (c["key"] == acc["key"]) & (c["digest"] == acc["digest"]))
        above = F.floor(acc["key"] / F.lit(fan)).cast("bigint")
        return F.struct(
            (acc["ok"] & F.coalesce(holds, F.lit(False)) & (node["at"] == above)).alias("ok"),
            above.alias("key"),
            _digest(node["level"], node["at"], node["children"]).alias("digest"),
        )

    end = F.aggregate(path, start, climb)
    return F.coalesce(end["ok"] & (end["digest"] == root_digest) & (F.size(path) > 0), F.lit(False))
