"""Composed ingest: raw records become stored, numbered and chained events, with rejects and statistics, in one transaction.

Each micro-batch is parsed once. Accepted records are de-duplicated, ordered by time, numbered after the last stored id and
chained from the last stored hash; rejects keep their stage and reason; statistics count by source. Every micro-batch
writes folders of its own batch id, and at last its row in ``commits``, which names the last id and the number of rows. A
micro-batch that fails before that leaves nothing that a reader sees, and when it is repeated it starts from the same id and
hash and replaces its own folders.

Chains run by segments of ids (see ``operators.chain``), so a micro-batch extends one open segment and adds whole ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sleuthframe.functions.columns import text
from sleuthframe.operators import chain
from sleuthframe.operators.normalize import deduplicate, next_ids, staged
from sleuthframe.session import cut_lineage, passing_tables
from sleuthframe.streaming.jobs import _save, _start

SEGMENT = 100_000
TABLES = ("events", "rejects", "stats", "tips")


def committed(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """A table of the ledger, with ``batch``, of committed micro-batches only."""
    commits = spark.read.parquet(f"{path}/commits").select("batch")
    rows = spark.read.parquet(f"{path}/{name}").join(commits, "batch", "left_semi")
    return rows if before is None else rows.where(F.col("batch") < before)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The stored events with their hash columns and chain."""
    return committed(spark, path, "events").drop("batch")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Counts by source over all committed micro-batches."""
    stats = committed(spark, path, "stats")
    counts = [c for c in stats.columns if c not in ("batch", "source", "last_event_time")]
    return stats.groupBy("source").agg(*[F.sum(c).alias(c) for c in counts], F.max("last_event_time").alias("last_event_time"))


def _resume(spark: SparkSession, path: str, batch: int) -> tuple[int, Row | None]:
    """Last id, and chain and tip of the open segment, after the micro-batches before this one."""
    if batch == 0:
        return 0, None
    commits = spark.read.parquet(f"{path}/commits").where(F.col("batch") < batch)
    last = commits.agg(F.max("last_id")).first()[0] or 0
    tips = committed(spark, path, "tips", batch)
    # Only the segment that the next id falls into can go on; it has a row for each micro-batch that extended it.
    open_ = tips.where(F.col("chain") == F.floor(F.lit(last) / F.lit(tips_segment(commits))).cast("string"))
    return last, open_.groupBy("chain").agg(F.max_by("tip", "tip_id").alias("tip")).first()


def tips_segment(commits: DataFrame) -> int:
    """The segment length that the ledger was started with."""
    return commits.agg(F.max("segment_rows")).first()[0]


def ingest_batch(raw: DataFrame, path: str, batch: int, dedup: bool = True, segment_rows: int = SEGMENT) -> None:
    """Work one micro-batch of ``raw(batch_pos, raw)`` into the ledger below ``path``."""
    spark = raw.sparkSession
    parsed = cut_lineage(staged(raw))
    last, tip = _resume(spark, path, batch)
    good = parsed.where("stage IS NULL").drop("stage", "reason")
    numbered = next_ids(deduplicate(good) if dedup else good, last)
    segment = chain.segment(segment_rows)
    # At most one chain goes on, so its tip travels with the plan; a join would send a table to the driver and back.
    seed = None if tip is None else F.when(segment.cast("string") == tip["chain"], F.lit(tip["tip"]))
    built = cut_lineage(chain.build_chain(numbered, segment, seed=seed))
    found = chain.chain_tips(built)
    # Records whose source could not be read are counted under no source.
    source = F.coalesce(F.when(text("source") != "", F.col("source")), F.lit("")).alias("source")
    stage = lambda s: F.count_if(F.coalesce(F.col("stage") == s, F.lit(False)))
    received = parsed.groupBy(source).agg(
        F.count("*").alias("received"), stage("normalize").alias("errors"), stage("validation").alias("skipped"),
        F.count_if(F.col("stage").isNull()).alias("_valid"),
    )
    stored = built.groupBy("source").agg(F.count("*").alias("inserted"), F.max("ts").alias("last_event_time"))
    # Both have a row per source; every stored source was received.
    both = received.unionByName(stored, allowMissingColumns=True).groupBy("source").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "inserted", "skipped", "errors", "_valid")],
        F.max("last_event_time").alias("last_event_time"),
    )
    duplicates = (F.col("_valid") - F.col("inserted")).alias("duplicates")
    stats = both.select("source", "received", "inserted", duplicates, "skipped", "errors", "last_event_time")
    _save(built, f"{path}/events", batch)
    _save(parsed.where("stage IS NOT NULL").select("batch_pos", "source", "stage", "reason"), f"{path}/rejects", batch)
    _save(stats, f"{path}/stats", batch)
    _save(found, f"{path}/tips", batch)
    end = built.agg(F.coalesce(F.max("id"), F.lit(last)).alias("last_id"), F.count("*").alias("rows"))
    _save(end.withColumn("segment_rows", F.lit(segment_rows)), f"{path}/commits", batch)


def ingest_ledger(raw: DataFrame, path: str, state: str, dedup: bool = True, segment_rows: int = SEGMENT, once: bool = True) -> StreamingQuery:
    """Follow a stream of raw records."""

    def each(batch: DataFrame, n: int) -> None:
        with passing_tables(batch.sparkSession):
            ingest_batch(batch, path, n, dedup, segment_rows)

    return _start(raw, each, state, once)
