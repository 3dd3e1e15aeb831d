"""Activity baseline: plain histograms of past events, as long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.columns import category, text
from sleuthframe.session import cut_lineage

DIMENSIONS = ["source", "event_type", "category", "severity", "user", "device"]


def behavior_features(events: DataFrame) -> DataFrame:
    """The columns that a baseline counts and a score compares."""
    return events.select(
        "*",
        text("source").alias("_source"),
        text("event_type").alias("_event_type"),
        category(text("source"), text("event_type")).alias("_category"),
        text("severity").alias("_severity"),
        text("user").alias("_user"),
        text("device").alias("_device"),
        F.hour("ts").alias("_hour"),
        F.weekday("ts").alias("_weekday"),
    )


@dataclass
class Baseline:
    """``profile`` counts the distinct combinations of the compared columns; all other tables derive from it."""

    profile: DataFrame
    min_events: int = 20
    is_settled: bool = False

    def totals(self) -> DataFrame:
        total = F.coalesce(F.sum("n"), F.lit(0))
        return self.profile.agg(
            total.alias("total_events"),
            F.coalesce(F.sum(F.when(F.col("_hour").isNotNull(), F.col("n"))), F.lit(0)).alias("timestamped_events"),
        ).withColumn(
            "status", F.when(F.col("total_events") >= self.min_events, "ready").otherwise("insufficient_history")
        )

    def categorical(self) -> DataFrame:
        """(dim, value, n); empty values are not counted."""
        pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"_{d}").alias("value")) for d in DIMENSIONS])
        return (
            self.profile.select("n", F.inline(pairs))
            .where("value <> ''")
            .groupBy("dim", "value")
            .agg(F.sum("n").alias("n"))
        )

    def hours(self) -> DataFrame:
        """(hour, n) of the whole endpoint."""
        return self.profile.where("_hour IS NOT NULL").groupBy(F.col("_hour").alias("hour")).agg(F.sum("n").alias("n"))

    def days(self) -> DataFrame:
        return self.profile.where("_hour IS NOT NULL").groupBy(F.col("_weekday").alias("weekday")).agg(F.sum("n").alias("n"))

    def subject_hours(self) -> DataFrame:
        """(scope, subject, hour, n) per user and per device."""
        pairs = F.array(
            F.struct(F.lit("user").alias("scope"), F.col("_user").alias("subject")),
            F.struct(F.lit("device").alias("scope"), F.col("_device").alias("subject")),
        )
        return (
            self.profile.where("_hour IS NOT NULL")
            .select(F.col("_hour").alias("hour"), "n", F.inline(pairs))
            .where("subject <> ''")
            .groupBy("scope", "subject", "hour")
            .agg(F.sum("n").alias("n"))
        )

    def hour_stats(self) -> DataFrame:
        """Mean and population deviation of the 24 zero-filled hours."""
        slots = self.hours().agg(hour_slots().alias("slots"))
        return slots.select(slot_mean(F.col("slots")).alias("hourly_mean"), slot_std(F.col("slots")).alias("hourly_std"))

    def settled(self) -> Baseline:
        """Keep the profile in the checkpoint folder, so that scoring does not read the history again."""
        return self if self.is_settled else Baseline(cut_lineage(self.profile), self.min_events, True)


def hour_slots() -> Column:
    """Aggregate (hour, n) rows to an array of 24 counts."""
    found = F.map_from_entries(F.collect_list(F.struct("hour", "n")))
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(found[h], F.lit(0)))


def slot_total(slots: Column) -> Column:
    return F.aggregate(slots, F.lit(0).cast("bigint"), lambda a, c: a + c)


def slot_mean(slots: Column) -> Column:
    return slot_total(slots) / F.lit(24.0)


def slot_std(slots: Column) -> Column:
    mean = slot_mean(slots)
    return F.sqrt(F.aggregate(slots, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)) / F.lit(24.0))


def learn(events: DataFrame, min_events: int = 20) -> Baseline:
    """Learn a baseline. Events without a time count for the categories only."""
    if min_events < 1:
        raise ValueError("min_events must be at least 1")
    keys = [f"_{d}" for d in DIMENSIONS] + ["_hour", "_weekday"]
    return Baseline(behavior_features(events).groupBy(*keys).agg(F.count("*").alias("n")), min_events)
