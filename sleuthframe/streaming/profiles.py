"""A baseline that grows with the stream and slides over days.

The profile of a baseline is a table of counts, so profiles of parts add up. Each micro-batch is counted once, by day, and its
counts are stored under its batch id; a baseline over any range of days is the sum of stored counts, so history is never
read again and days leave the window without being subtracted event by event. ``version`` tells whether anything new has been
counted: an analysis that has seen a version need not run again. Counts can be squashed to one row per key and day.

A micro-batch that is repeated replaces its own counts; readers see committed micro-batches only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sleuthframe.operators import scoring
from sleuthframe.operators.baseline import DIMENSIONS, Baseline, behavior_features
from sleuthframe.streaming.jobs import _save, _start

KEYS = [f"_{d}" for d in DIMENSIONS] + ["_hour", "_weekday"]


def count_batch(events: DataFrame, path: str, batch: int) -> None:
    """Count one micro-batch into the profile below ``path``."""
    spark = events.sparkSession
    counted = behavior_features(events).groupBy(F.to_date("ts").alias("day"), *KEYS).agg(F.count("*").alias("n"))
    _save(counted.repartitionByRange("day").sortWithinPartitions("day"), f"{path}/profile", batch)
    _save(spark.range(1).select(F.current_timestamp().alias("at")), f"{path}/commits", batch)


def follow_profile(events: DataFrame, path: str, state: str, once: bool = True) -> StreamingQuery:
    def each(batch: DataFrame, n: int) -> None:
        count_batch(batch, path, n)

    return _start(events, each, state, once)


def _last(spark: SparkSession, path: str) -> int:
    """The highest batch of a table, -1 where there is none."""
    try:
        return spark.read.parquet(path).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    except AnalysisException:
        return -1


def version(spark: SparkSession, path: str) -> int:
    """The last committed micro-batch, -1 before the first."""
    return _last(spark, f"{path}/commits")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, compared columns, n) of all committed micro-batches, not yet summed."""
    squashed = _last(spark, f"{path}/squashes")
    commits = spark.read.parquet(f"{path}/commits").select("batch")
    rows = spark.read.parquet(f"{path}/profile").where(F.col("batch") > squashed).join(commits, "batch", "left_semi")
    if squashed >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/squashed").where(F.col("batch") == squashed))
    return rows


def baseline(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None, min_events: int = 20
) -> Baseline:
    """The baseline of the days ``first`` to ``last``, both included; events without a time count only without bounds."""
    rows = counts(spark, path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last))
    return Baseline(rows.groupBy(*KEYS).agg(F.sum("n").alias("n")), min_events).settled()


def squash(spark: SparkSession, path: str) -> int:
    """Sum the counts of all committed micro-batches to one row per key and day; returns the last of them.

    The sum is a table of its own, read from when its marker is written; should its last micro-batch be repeated
    later, that one's counts are not read any more.
    """
    at = version(spark, path)
    if at >= 0 and at > _last(spark, f"{path}/squashes"):
        summed = counts(spark, path).groupBy("day", *KEYS).agg(F.sum("n").alias("n"))
        _save(summed.repartitionByRange("day").sortWithinPartitions("day"), f"{path}/squashed", at)
        _save(spark.range(1).select(F.current_timestamp().alias("at")), f"{path}/squashes", at)
    return at


def score_when_new(
    events: DataFrame, path: str, seen: int, first: dt.date | None = None, last: dt.date | None = None, **options
) -> tuple[DataFrame | None, int]:
    """(scores, version): scores of ``events`` by the stored profile, or None where ``seen`` is still its version."""
    spark = events.sparkSession
    now = version(spark, path)
    if now == seen:
        return None, now
    return scoring.score(events, baseline(spark, path, first, last), **options), now
