"""Counts and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import from_micros, micros, severity_weight, text
from sleuthframe.operators.chain import verify
from sleuthframe.operators.retrieve import recent, where_equal
from sleuthframe.vocabulary import COLLECTOR_KEYWORDS, TEXT_COLUMNS

GROUPABLE = ["source", "severity", "event_type", "user", "device"]


def count_events(events: DataFrame, **filters) -> DataFrame:
    return where_equal(events, **filters).agg(F.count("*").alias("n"))


def count_by(events: DataFrame, column: str) -> DataFrame:
    """Rows per value; null and '' are one group."""
    if column not in GROUPABLE:
        raise ValueError(f"column not groupable: {column!r}")
    return events.groupBy(text(column).alias("value")).agg(F.count("*").alias("n"))


def source_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("events"), F.max("ts").alias("last_event_time"))


def severity_breakdown(events: DataFrame) -> DataFrame:
    """Severities with their share of all events, heaviest first."""
    counts = count_by(events, "severity")
    total = F.sum("n").over(W.partitionBy())
    return counts.select(
        F.col("value").alias("severity"),
        "n",
        total.alias("total"),
        (F.col("n") / total).alias("share"),
        severity_weight(F.col("value")).alias("weight"),
    ).orderBy(F.desc("weight"), F.desc("n"), "severity")


def top_sources(events: DataFrame, k: int = 10) -> DataFrame:
    return count_by(events, "source").orderBy(F.desc("n"), "value").limit(k)


def activity_buckets(events: DataFrame, most: int = 24, least: int = 6) -> DataFrame:
    """Equal time slots between the first and the last event, empty slots included; times in milliseconds."""
    ms = F.floor(micros(F.col("ts")) / 1000)
    timed = events.where("ts IS NOT NULL").select(ms.alias("t"))
    span = timed.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).select(
        "lo",
        F.least(F.lit(most), F.greatest(F.lit(least), "n")).cast("int").alias("slots"),
        F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).alias("span"),
    )
    size = span.select("*", (F.col("span") / F.col("slots")).alias("size"))
    s = timed.withColumn("s", size.select(F.struct("lo", "slots", "size")).scalar())
    slot = F.least(F.col("s.slots") - 1, F.floor((F.col("t") - F.col("s.lo")) / F.col("s.size"))).cast("int")
    counts = s.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    grid = size.where("lo IS NOT NULL").select(
        "lo", "size", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    )
    return grid.join(counts, "slot", "left").select(
        "slot",
        from_micros(F.floor((F.col("lo") + F.col("slot") * F.col("size")) * 1000)).alias("slot_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _claims(name: Column, words: list[str]) -> Column:
    test = None
    for w in words:
        hit = F.contains(F.lower(name), F.lit(w))
        test = hit if test is None else test | hit
    return test


def collector_attribution(events: DataFrame) -> DataFrame:
    """Events per collector by source keyword; a source may count for several, unclaimed sources follow as others."""
    by_source = count_by(events, "source")
    claimed = F.array_compact(
        F.array(*[F.when(_claims(F.col("value"), words), F.lit(c)) for c, words in COLLECTOR_KEYWORDS.items()])
    )
    tagged = by_source.withColumn("c", claimed)
    hits = tagged.select("n", F.explode("c").alias("collector"))
    tally = hits.agg(*[F.coalesce(F.sum(F.when(F.col("collector") == c, F.col("n"))), F.lit(0)).alias(c) for c in COLLECTOR_KEYWORDS])
    known = tally.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("collector"), F.lit("").alias("source"), F.col(c).alias("n")) for c in COLLECTOR_KEYWORDS]))
    )
    others = tagged.where(F.size("c") == 0).select(F.lit("other").alias("collector"), F.col("value").alias("source"), "n")
    return known.unionByName(others)


def dashboard(events: DataFrame, incidents: DataFrame, scored: DataFrame, chain: str | None = None) -> DataFrame:
    """One row: totals by source and severity, newest ten rows, latest time, incidents, anomalies and the chain status."""
    head = events.agg(F.count("*").alias("total_events"), F.max("ts").alias("latest_event_time"))
    n_incidents = incidents.agg(F.count("*")).scalar()
    n_anomalies = scored.agg(F.count_if(F.col("classification").isin("SUSPICIOUS", "ANOMALOUS"))).scalar()
    status = verify(events, chain).select("status").scalar()
    counts = lambda c: count_by(events, c).agg(F.array_sort(F.collect_list(F.struct("value", "n")))).scalar()
    # Ten rows, put in order again since a limit gives none to the aggregate.
    rows = F.struct("ts", "id", *TEXT_COLUMNS)
    newest = recent(events).agg(F.reverse(F.array_sort(F.collect_list(rows)))).scalar()
    return head.select(
        "*",
        n_incidents.alias("candidate_incident_count"),
        n_anomalies.alias("behavioral_anomaly_count"),
        status.alias("integrity_status"),
        counts("source").alias("by_source"),
        counts("severity").alias("by_severity"),
        newest.alias("recent_events"),
    )
