"""Raw records to events: alias resolution, validation, de-duplication and run statistics.

A raw record is one JSON object in the column ``raw``; ``batch_pos`` is its place in the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import strip
from sleuthframe.functions.timestamps import from_variant
from sleuthframe.session import stored
from sleuthframe.vocabulary import EVENT_COLUMNS, FIELD_ALIASES

MAPPED_KEYS = sorted({k for keys in FIELD_ALIASES.values() for k in keys} | {"metadata"})
FINGERPRINT = ["ts", "source", "event_type", "description", "user", "device", "file_path", "metadata"]


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _filled(v: Column) -> Column:
    """Present: neither missing, null nor the empty text."""
    return F.coalesce(_as_text(v) != "", F.lit(False))


def _first_filled(field: str) -> Column:
    """First alias with a value, as a variant; ``m`` holds filled values only."""
    return F.coalesce(*[F.col("m")[k] for k in FIELD_ALIASES[field]])


def _metadata() -> Column:
    """Explicit metadata merged with every unmapped key, keys sorted, '' when nothing is left."""
    given = F.col("m")["metadata"]
    is_object = F.schema_of_variant(given).startswith("OBJECT")
    none = F.expr("cast(map() as map<string,variant>)")
    explicit = (
        F.when(is_object, F.try_variant_get(given, "$", "map<string,variant>"))
        .when(given.isNotNull(), F.create_map(F.lit("metadata"), given))
        .otherwise(none)
    )
    extra = F.map_filter("m", lambda k, v: ~k.isin(MAPPED_KEYS))
    merged = F.map_concat(F.coalesce(explicit, none), F.coalesce(extra, none))

    def member(e: Column) -> Column:
        """One ``"key":value`` text, with the key for sorting; a variant itself cannot be ordered."""
        shown = F.to_json(F.map_from_arrays(F.array(e["key"]), F.array(e["value"])), {"ignoreNullFields": "false"})
        return F.struct(e["key"].alias("k"), F.substring(shown, F.lit(2), F.length(shown) - 2).alias("t"))

    members = F.array_sort(F.transform(F.map_entries(merged), member))
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda x: x["t"]), ","), F.lit("}"))


def staged(raw: DataFrame, source: str | None = None, event_type: str | None = None) -> DataFrame:
    """Every record with its event fields and the stage and reason that reject it, if any."""
    # One generated row per record: the parsed map and then the resolved fields are computed once, where a plain
    # projection would be merged into every expression that reads them.
    filled = F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, v: _filled(v))
    parsed = raw.select("batch_pos", F.explode(F.array(filled)).alias("m"))
    fields = F.struct(
        (F.lit(source) if source else _as_text(_first_filled("source"))).alias("source"),
        (F.lit(event_type) if event_type else _as_text(_first_filled("event_type"))).alias("event_type"),
        _first_filled("timestamp").alias("_t"),
        *[F.coalesce(_as_text(_first_filled(f)), F.lit(d)).alias(f) for f, d in
          (("description", ""), ("severity", "INFO"), ("user", ""), ("device", ""), ("file_path", ""))],
        _metadata().alias("metadata"),
    )
    typed = parsed.select("batch_pos", F.col("m").isNull().alias("_unread"), F.inline(F.array(fields)))
    # Again a generated row: a filter on ``stage`` would otherwise parse every time once more.
    timed = F.struct(from_variant(F.col("_t")).alias("ts"), F.col("_t").isNull().alias("_untimed"))
    typed = typed.select("*", F.inline(F.array(timed))).withColumn(
        "metadata", F.when(F.col("metadata") != "{}", F.col("metadata")).otherwise("")
    )
    failure = (
        F.when(F.col("_unread"), "record is not a JSON object")
        .when(F.col("source").isNull(), "source is required")
        .when(F.col("event_type").isNull(), "event_type is required")
        .when(F.col("_untimed"), "timestamp is missing")
        .when(F.col("ts").isNull(), "timestamp is not recognized")
    )
    blank = None
    for name in ("source", "event_type", "description"):
        test = strip(name) == ""
        said = f"{name} is required but empty"
        blank = F.when(test, said) if blank is None else blank.when(test, said)
    return typed.select(
        "batch_pos",
        "ts",
        "source",
        "event_type",
        "description",
        "severity",
        "user",
        "device",
        "file_path",
        "metadata",
        F.when(failure.isNotNull(), "normalize").when(blank.isNotNull(), "validation").alias("stage"),
        F.coalesce(failure, blank).alias("reason"),
    )


def normalize(raw: DataFrame, source: str | None = None, event_type: str | None = None) -> DataFrame:
    """Accepted events; explicit ``source`` / ``event_type`` win over what the record says."""
    return staged(raw, source, event_type).where("stage IS NULL").drop("stage", "reason")


def rejects(raw: DataFrame, source: str | None = None, event_type: str | None = None) -> DataFrame:
    return staged(raw, source, event_type).where("stage IS NOT NULL").select("batch_pos", "stage", "reason")


def deduplicate(events: DataFrame) -> DataFrame:
    """Keep the first row, in batch order, of rows equal in eight fields; the severity is not compared.

    A min per fingerprint: copies collapse on the map side, so a group of any size shuffles as one row per task.
    """
    rest = [c for c in events.columns if c not in FINGERPRINT and c != "batch_pos"]
    first = events.groupBy(*FINGERPRINT).agg(F.min(F.struct("batch_pos", *rest)).alias("_first"))
    return first.select("_first.batch_pos", *FINGERPRINT, *[F.col(f"_first.{c}") for c in rest]).select(events.columns)


def ingest_stats(raw: DataFrame, dedup: bool = False) -> DataFrame:
    """One row of run statistics. The records are parsed once, also where copies are counted."""
    parsed = staged(raw)
    if dedup:
        parsed = stored(parsed)
    counts = parsed.agg(
        F.count("*").alias("received"),
        F.count_if(F.coalesce(F.col("stage") != "normalize", F.lit(True))).alias("normalized"),
        F.count_if(F.coalesce(F.col("stage") == "validation", F.lit(False))).alias("skipped"),
        F.count_if(F.coalesce(F.col("stage") == "normalize", F.lit(False))).alias("errors"),
        F.count_if(F.col("stage").isNull()).alias("_valid"),
    )
    if not dedup:
        return counts.select(
            "received", "normalized", F.col("_valid").alias("inserted"), "skipped", F.lit(0).cast("bigint").alias("duplicates"),
            "errors",
        )
    kept = deduplicate(parsed.where("stage IS NULL")).agg(F.count("*").alias("k")).scalar()
    return counts.withColumn("inserted", kept).select(
        "received", "normalized", "inserted", "skipped", (F.col("_valid") - F.col("inserted")).alias("duplicates"), "errors"
    )


def next_ids(events: DataFrame, start: int = 0) -> DataFrame:
    """Give new rows ids in storage order after ``start``.

    A range sort splits the rows over tasks, each task counts its own rows and only the counts per task (one row
    per partition) are summed in order, so no task sees more than its range.
    """
    # A range sort reads its input twice, to sample it and to sort it, so what makes the rows is run once before.
    ordered = stored(
        stored(events).orderBy("ts", "batch_pos").select(
            "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")
        )
    )
    ordered = ordered.withColumn("_row", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ordered.join(F.broadcast(offsets), "_p").withColumn("id", F.col("_before") + F.col("_row") + 1 + F.lit(start))
    keep = [c for c in EVENT_COLUMNS if c in out.columns]
    return out.select(*keep)
