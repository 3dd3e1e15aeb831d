"""Deviation of events from a baseline: a bounded sum of explained signals, not a probability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.columns import iso, lookup, reference_text
from sleuthframe.operators.baseline import (
    Baseline,
    behavior_features,
    hour_slots,
    learn,
    slot_mean,
    slot_std,
    slot_total,
)
from sleuthframe.vocabulary import CLASS_SEVERITY, CLASSES

# Weights for a value never seen and for a rare one.
UNSEEN_RARE = {
    "source": (40.0, 15.0),
    "category": (35.0, 12.0),
    "event_type": (30.0, 12.0),
    "user": (30.0, 12.0),
    "device": (30.0, 10.0),
    "severity": (25.0, 10.0),
}
UNSEEN_HOUR, LOW_HOUR, UNSEEN_DAY = 30.0, 20.0, 10.0
# Words used in reasons.
CATEGORY_NOUN = {
    "usb": "USB activity",
    "file": "File activity",
    "browser": "Browser activity",
    "defender": "Defender activity",
    "windows": "Windows event activity",
    "other": "Activity",
}
VALUE_NOUN = {
    "source": "Source", "event_type": "Event type", "user": "User", "device": "Device", "severity": "Severity",
}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CONSISTENT = "Activity is consistent with the established baseline."

# At most this many common values per dimension are carried with the plan (a share of 1/N each).
MAX_COMMON = 10_000


@dataclass(frozen=True)
class Thresholds:
    min_subject_events: int = 5
    rare_threshold: float = 0.05
    z_threshold: float = 2.0
    suspicious_score: float = 30.0
    anomalous_score: float = 60.0

    def __post_init__(self):
        if self.min_subject_events < 1:
            raise ValueError("min_subject_events must be at least 1")
        if not 0.0 <= self.rare_threshold <= 1.0:
            raise ValueError("rare_threshold must be between 0 and 1")
        if self.z_threshold < 0:
            raise ValueError("z_threshold must be non-negative")
        if not 0 <= self.suspicious_score <= self.anomalous_score <= 100:
            raise ValueError("need 0 <= suspicious_score <= anomalous_score <= 100")


def _model_row(base: Baseline, rare: float) -> DataFrame:
    """One row with all that is small by construction: totals, 24 hours, 7 weekdays, the category counts and, per
    dimension, the values with at least the rare share (at most 1/rare of them)."""
    totals = base.totals()
    counts = base.categorical()
    if rare * MAX_COMMON >= 1:
        total = totals.select(F.col("total_events").cast("double")).scalar()
        common = counts.where(F.col("n") / total >= rare)
    else:
        common = counts.where("dim = 'category'")
    known = common.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("dim", "value"), "n"))).alias("common"))
    cats = counts.where("dim = 'category'").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("cats"))
    slots = base.hours().agg(hour_slots().alias("slots"))
    days = base.days().agg(F.collect_set("weekday").alias("days"))
    return totals.select(
        F.struct(
            "total_events",
            "timestamped_events",
            "status",
            known.select("common").scalar().alias("common"),
            cats.select("cats").scalar().alias("cats"),
            slots.select("slots").scalar().alias("slots"),
            days.select("days").scalar().alias("days"),
        )
    )


def _subject_profiles(base: Baseline, least: int) -> tuple[DataFrame, DataFrame]:
    """Users and devices with enough timed events: 24 counts with mean and deviation, one row each."""
    rows = base.subject_hours().groupBy("scope", "subject").agg(hour_slots().alias("slots"))
    rows = rows.where(slot_total(F.col("slots")) >= least)
    made = rows.select("scope", "subject", F.struct(
        "slots", slot_mean(F.col("slots")).alias("mean"), slot_std(F.col("slots")).alias("std")
    ).alias("hours"))
    return tuple(
        made.where(F.col("scope") == s).select(F.col("subject").alias(f"_{s}_key"), F.col("hours").alias(f"_{s}_hours"))
        for s in ("user", "device")
    )


def _spread(wanted: Column, value: Column) -> Column:
    """Join key; rows that need no match get one of many keys that match nothing, so they do not pile up."""
    idle = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("_row"), F.lit(4096)).cast("string"))
    return F.when(wanted, value).otherwise(idle)


def score(
    events: DataFrame,
    baseline: Baseline | None = None,
    limits: Thresholds = Thresholds(),
    min_events: int = 20,
    explain: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Score every event against ``baseline``, or against themselves when none is given.

    Values with at least the rare share are decided from the model row. Only the others are looked up, and not even
    those when the events are their own history (nothing is unseen then) unless ``explain`` asks for the percentages.
    ``keep`` names extra columns to carry along.
    """
    own = baseline is None
    # The history is read once; every table of the model comes from the settled profile.
    base = (baseline or learn(events, min_events)).settled()
    rare = limits.rare_threshold
    rows = behavior_features(events).withColumn(
        "_row", F.struct("id", *(keep or []))
    ).select(
        *(keep or []), "id", "ts", "source", "event_type", "_row",
        *[f"_{d}" for d in UNSEEN_RARE], "_hour", "_weekday",
    )
    model = _model_row(base, rare)

    # Hour profiles of the subject: user first, else device.
    users, devices = _subject_profiles(base, limits.min_subject_events)
    timed = F.col("_hour").isNotNull()
    rows = rows.withColumn("_user_key", _spread(timed & (F.col("_user") != ""), F.col("_user")))
    rows = rows.join(users, "_user_key", "left").drop("_user_key")
    rows = rows.withColumn(
        "_device_key", _spread(timed & (F.col("_device") != "") & F.col("_user_hours").isNull(), F.col("_device"))
    )
    rows = rows.join(devices, "_device_key", "left").drop("_device_key")
    rows = rows.withColumn("_b", model.scalar())
    b = F.col("_b")
    total = b["total_events"]

    # Counts of the event's own values.
    look = {d: F.col(f"_{d}") for d in UNSEEN_RARE if d != "category"}
    common = {d: b["common"][F.struct(F.lit(d).alias("dim"), v.alias("value"))] for d, v in look.items()}
    asked = {d: look[d] != "" for d in look}
    asked["source"] = asked["source"] & (F.col("_category") == "other")
    if own and not explain:
        # Own history: a value that is not common has been seen at least once.
        seen = {d: F.coalesce(common[d], F.lit(1)) for d in look}
        is_rare = {d: common[d].isNull() for d in look} if rare * MAX_COMMON >= 1 else None
    else:
        is_rare = None
    if is_rare is None:
        counts = base.categorical()
        for d, v in look.items():
            rows = rows.withColumn("_k", _spread(asked[d] & common[d].isNull(), v))
            mine = counts.where(F.col("dim") == d).select(F.col("value").alias("_k"), F.col("n").alias(f"_n_{d}"))
            rows = rows.join(mine, "_k", "left").drop("_k")
        seen = {d: F.coalesce(common[d], F.col(f"_n_{d}"), F.lit(0)) for d in look}
        is_rare = {d: seen[d] / total < rare for d in look}
    seen["category"] = F.coalesce(b["cats"][F.col("_category")], F.lit(0))
    is_rare["category"] = seen["category"] / total < rare
    asked["category"] = F.col("_category") != "other"

    found = []
    for d, (unseen_weight, rare_weight) in UNSEEN_RARE.items():
        share = F.concat(F.format_string("%.1f", F.lit(100.0) * seen[d] / total), F.lit("%"))
        if d == "category":
            noun = lookup(F.col("_category"), CATEGORY_NOUN, "Activity")
            new = F.concat(noun, F.lit(" has not appeared in the baseline."))
            few = F.concat(
                noun, F.lit(" is unusual compared with historical behaviour ("), share, F.lit(" of events).")
            )
        else:
            noun = F.concat(F.lit(f"{VALUE_NOUN[d]} '"), look[d], F.lit("'"))
            new = F.concat(noun, F.lit(" has not appeared in the baseline."))
            few = F.concat(noun, F.lit(" is rare in the baseline ("), share, F.lit(")."))
        found.append(
            F.when(asked[d] & (seen[d] == 0), _signal(f"unusual_{d}", unseen_weight, new if explain else None)).when(
                asked[d] & is_rare[d], _signal(f"unusual_{d}", rare_weight, few if explain else None)
            )
        )

    mean, std = slot_mean(b["slots"]), slot_std(b["slots"])
    whole = F.struct(b["slots"].alias("slots"), mean.alias("mean"), std.alias("std"))
    rows = rows.withColumn("_found", F.array(*found)).withColumn(
        "_hours", F.coalesce("_user_hours", "_device_hours", whole)
    )
    rows = rows.withColumn("_here", F.col("_hours.slots")[F.col("_hour")])
    rows = rows.withColumn(
        "_z",
        F.when(F.col("_hours.std") > 0, (F.col("_here") - F.col("_hours.mean")) / F.col("_hours.std")).otherwise(0.0),
    )
    whose = (
        F.when(F.col("_user_hours").isNotNull(), F.concat(F.lit("user '"), "_user", F.lit("'")))
        .when(F.col("_device_hours").isNotNull(), F.concat(F.lit("device '"), "_device", F.lit("'")))
        .otherwise("the endpoint")
    )
    clock = F.format_string("%02d:00", "_hour")
    active = timed & (F.col("_hours.mean") > 0)
    day = F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), F.col("_weekday") + 1)
    time_signals = F.array(
        F.when(
            active & (F.col("_here") == 0),
            _signal(
                "unusual_hour",
                UNSEEN_HOUR,
                F.concat(F.lit("Activity occurred at "), clock, F.lit(", outside the normal active hours for "), whose, F.lit("."))
                if explain
                else None,
            ),
        ).when(
            active & (F.col("_z") <= -limits.z_threshold),
            _signal(
                "unusual_frequency",
                LOW_HOUR,
                F.concat(
                    F.lit("Activity at "), clock, F.lit(" is significantly below the normal level for "), whose,
                    F.lit(" (z-score "), F.format_string("%.2f", "_z"), F.lit(")."),
                )
                if explain
                else None,
            ),
        ),
        F.when(
            timed & (b["timestamped_events"] > 0) & ~F.array_contains(b["days"], F.col("_weekday")),
            _signal(
                "unusual_day",
                UNSEEN_DAY,
                F.concat(F.lit("Activity occurred on "), day, F.lit(", a day with no baseline activity."))
                if explain
                else None,
            ),
        ),
    )
    ready = b["status"] == "ready"
    rows = rows.withColumn("_all", F.array_compact(F.concat(F.col("_found"), time_signals)))
    raw = F.aggregate("_all", F.lit(0.0), lambda a, s: a + s["weight"])
    rows = rows.withColumn(
        "anomaly_score",
        F.when(ready, F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 4)).otherwise(0.0),
    ).withColumn(
        "classification",
        F.when(~ready, "INSUFFICIENT_HISTORY")
        .when(F.col("anomaly_score") >= limits.anomalous_score, "ANOMALOUS")
        .when(F.col("anomaly_score") >= limits.suspicious_score, "SUSPICIOUS")
        .otherwise("NORMAL"),
    )
    signals = F.array_sort(F.array_distinct(F.transform("_all", lambda s: s["signal"])))
    none = F.array().cast("array<string>")
    out = [
        *(keep or []), "id", "ts", "source", "event_type", F.col("_category").alias("category"),
        F.col("_hour").alias("hour"), F.col("_weekday").alias("weekday"), "anomaly_score", "classification",
        lookup(F.col("classification"), CLASS_SEVERITY, "INFO").alias("severity"),
        F.when(ready, signals).otherwise(none).alias("signals"),
        b["status"].alias("baseline_status"),
    ]
    if explain:
        said = F.array_sort(F.array_distinct(F.transform("_all", lambda s: s["reason"])))
        cold = F.format_string(
            "Insufficient baseline history: %d event(s) observed, "
            + f"{base.min_events} required; activity cannot be assessed as anomalous yet.",
            total,
        )
        out.append(
            F.when(~ready, F.array(cold)).when(F.size(said) == 0, F.array(F.lit(CONSISTENT))).otherwise(said).alias("reasons")
        )
    return rows.select(*out)


def _signal(name: str, weight: float, reason: Column | None) -> Column:
    said = reason if reason is not None else F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("signal"), F.lit(weight).alias("weight"), said.alias("reason"))


def anomalies(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("classification").isin("SUSPICIOUS", "ANOMALOUS"))


def class_counts(scored: DataFrame) -> DataFrame:
    """All four classes, also those without events."""
    tally = scored.agg(*[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES])
    return tally.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("classification"), F.col(c).alias("n")) for c in CLASSES]))
    )


def findings(scored: DataFrame) -> DataFrame:
    """Report form of scored events."""
    return scored.select(
        "*", reference_text(F.col("id")).alias("event_reference"), iso(F.col("ts")).alias("timestamp")
    )
