"""Proportional stratified interleaving into shards.

Rows of each source are shuffled by a seeded hash and ranked; the rank over the number of rows of the source is the
row's fraction. Sorted by fraction, every stretch of the table holds the sources in the proportions of the whole. The
sequence is cut into shards whose row counts differ by one at most.

Both orders are global range sorts, so a source that holds most rows is spread over all tasks.

Defined cases: null sources are one source; null and empty texts are rows as any other; repeated rows are placed one by
one; an empty table gives an empty result; other columns travel inside ``_doc`` and can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import keyed, numbered, settle

SHARDS = 24
SEED = 17


def interleave(keys: DataFrame, shards: int = SHARDS, seed: int = SEED, carried: list[str] | None = None) -> DataFrame:
    """Shard and slot of each row of ``keys(_file, _row, id, source, ...)``; ``carried`` columns come along."""
    carried = carried or []
    # The hash of the id comes first, so files dealt out in another way change only ties.
    shuffled = keys.select("_file", "_row", "id", "source", *carried).withColumns(
        {"_first": F.xxhash64("id", F.lit(seed)), "_mix": F.xxhash64("_file", "_row")}
    )
    order = [F.asc_nulls_first("source"), F.col("_first"), F.col("_mix")]
    ranked = settle(numbered(shuffled, order))
    size = ranked.groupBy("source").agg(F.count("*").alias("_of"), F.min("_pos").alias("_from"))
    rows = ranked.count()
    # One row per source beside narrow rows; a hot source is split by the adaptive skew join.
    both = ranked.alias("r").join(settle(size).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    fraction = (F.col("_pos") - F.col("_from") + 0.5) / F.col("_of")
    spread = both.select(
        "_file", "_row", "id", "r.source", *carried, fraction.alias("_fraction"), "_first", "_mix"
    )
    mixed = numbered(spread, [F.col("_fraction"), F.col("_first"), F.col("_mix")])
    # Row p of n goes to shard floor(p * shards / n); shard k starts at row ceil(k * n / shards).
    shard = F.expr(f"(_pos * {shards}) div {max(rows, 1)}")
    start = F.expr(f"(_shard * {rows} + {shards - 1}) div {shards}")
    return mixed.withColumn("_shard", shard).select(
        "_file",
        "_row",
        "id",
        "source",
        *carried,
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - start).alias("slot"),
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """(_doc, shard, slot): whole rows with their places."""
    rows = keyed(docs)
    keys = rows.select("_file", "_row", F.col(f"_doc.`{id_col}`").alias("id"), F.col("_doc.source").alias("source"))
    placed = settle(interleave(keys, shards, seed).select("_file", "_row", "shard", "slot"))
    return rows.join(placed, ["_file", "_row"]).select("_doc", "shard", "slot")


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id"
) -> None:
    """One folder per shard, rows in the order of their slots; large shards become several files by ranges of slots."""
    placed = shard_rows(docs, shards, seed, id_col)
    ranges = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranges.select("_doc.*", "slot", "shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)
