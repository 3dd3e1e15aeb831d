"""Incremental reads against stored cursors.

``read_by_record_number`` keeps one number per channel, ``read_by_visit`` the last visit time per browser profile
with the fingerprints of the rows seen at exactly that time. Both return what to admit and the new cursor table,
which the caller stores after the admitted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import text


def url_key(url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a URL."""
    return F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16)


def read_by_record_number(records: DataFrame, cursors: DataFrame, backfill: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """``records(channel, record_number, ...)``, ``cursors(channel, record_number)``.

    Admits numbers above the cursor. Without a cursor, or after the log was cleared and its numbers started again,
    the newest ``backfill`` records are admitted, or all where it is None. The cursor moves to the highest number read.
    """
    valid = records.where("channel IS NOT NULL AND record_number IS NOT NULL")
    high = valid.groupBy("channel").agg(F.max("record_number").alias("_high"))
    old = cursors.select("channel", F.col("record_number").alias("_old"))
    state = high.join(old, "channel", "left").select(
        "channel", "_high", F.when(F.col("_high") >= F.col("_old"), F.col("_old")).otherwise(0).alias("_from")
    )
    # One row per channel joins the records, so a busy channel can be split over tasks.
    known = valid.join(state.where("_from <> 0"), "channel").where("record_number > _from").select(*records.columns)
    if backfill is None or backfill > 0:
        fresh = valid.join(state.where("_from = 0").select("channel"), "channel", "left_semi")
        if backfill is not None:
            newest = W.partitionBy("channel").orderBy(F.col("record_number").desc())
            fresh = fresh.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= backfill)
        known = known.unionByName(fresh.select(*records.columns))
    moved = old.join(high, "channel", "full").select("channel", F.coalesce("_high", "_old").alias("record_number"))
    return known, moved


def read_by_visit(
    visits: DataFrame, cursors: DataFrame, boundary: DataFrame, backfill: int | None = 100
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``visits(profile_key, ts, url, ...)``, ``cursors(profile_key, last_visit)``, ``boundary(profile_key, url_key)``.

    Admits visits after the cursor, and visits at the cursor time whose URL was not seen at that time; of a profile
    without a cursor the newest ``backfill`` visits, or all where it is None. The boundary is
    a table with one row per fingerprint, so it has no size limit.
    """
    timed = visits.where("ts IS NOT NULL").withColumn("_key", url_key(F.col("url")))
    old = cursors.select("profile_key", F.col("last_visit").alias("_old"))
    seen = boundary.select("profile_key", F.col("url_key").alias("_key"), F.lit(True).alias("_seen"))
    rows = timed.join(old, "profile_key", "left")
    later = rows.where(F.col("ts") > F.col("_old"))
    at = rows.where(F.col("ts") == F.col("_old")).join(seen, ["profile_key", "_key"], "left_anti")
    admitted = later.select(*visits.columns).unionByName(at.select(*visits.columns))
    if backfill is None or backfill > 0:
        fresh = rows.where("_old IS NULL")
        if backfill is not None:
            newest = W.partitionBy("profile_key").orderBy(F.col("ts").desc(), "url")
            fresh = fresh.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= backfill)
        admitted = admitted.unionByName(fresh.select(*visits.columns))
    read = timed.groupBy("profile_key").agg(F.max("ts").alias("_read"))
    moved = old.join(read, "profile_key", "full").select("profile_key", F.greatest("_old", "_read").alias("last_visit"), "_old")
    at_max = timed.join(moved, "profile_key").where(F.col("ts") == F.col("last_visit"))
    kept = boundary.join(moved.where(F.col("last_visit") == F.col("_old")).select("profile_key"), "profile_key", "left_semi")
    keys = kept.select("profile_key", "url_key").unionByName(
        at_max.select("profile_key", F.col("_key").alias("url_key"))
    ).distinct()
    return admitted, moved.select("profile_key", "last_visit"), keys


def profile_key(browser: Column, profile: Column) -> Column:
    q = lambda c: F.when(text(c) != "", c).otherwise("?")
    return F.concat(q(browser), F.lit("::"), q(profile))
