"""Structured Streaming jobs: ingest, cursors, re-read removal, live scores, sessions and counters.

Every job takes a streaming DataFrame and folders for its result and its checkpoint, and returns the started query.
``once=True`` works off what is there and stops. Sinks written per micro-batch go to a folder of their own batch id,
so that a batch which runs again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sleuthframe.operators import cursors, scoring
from sleuthframe.operators.baseline import Baseline
from sleuthframe.operators.normalize import deduplicate, normalize

DEFAULT_INTERVAL = "60 seconds"
RAW_SCHEMA = "batch_pos bigint, raw string"


def watch(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder, oldest first."""
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(each)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEFAULT_INTERVAL)
    return writer.start()


def _save(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(raw: DataFrame, sink: str, state: str, dedup: bool = False, once: bool = True) -> StreamingQuery:
    """Normalize raw JSON records and append the accepted ones."""

    def each(batch: DataFrame, n: int) -> None:
        good = normalize(batch)
        _save(deduplicate(good) if dedup else good, sink, n)

    return _start(raw, each, state, once)


def _latest(spark: SparkSession, path: str, before: int, schema: str) -> DataFrame:
    """State written by the last batch before this one; empty for the first batch."""
    empty = spark.createDataFrame([], schema)
    if before <= 0:
        return empty
    return spark.read.schema(schema).parquet(f"{path}/batch={before - 1}")


CURSOR_SCHEMA = "channel string, record_number bigint"


def follow_records(records: DataFrame, sink: str, cursor_path: str, state: str, backfill: int | None = 100, once: bool = True) -> StreamingQuery:
    """Admit records above the cursor of their channel. The cursor is written after the rows: a failed batch is
    read again from the same cursor."""

    def each(batch: DataFrame, n: int) -> None:
        old = _latest(batch.sparkSession, cursor_path, n, CURSOR_SCHEMA)
        admitted, moved = cursors.read_by_record_number(batch, old, backfill)
        _save(admitted, sink, n)
        _save(moved, cursor_path, n)

    return _start(records, each, state, once)


VISIT_SCHEMA = "profile_key string, last_visit timestamp_ntz"
BOUNDARY_SCHEMA = "profile_key string, url_key string"


def follow_visits(visits: DataFrame, sink: str, cursor_path: str, state: str, backfill: int | None = 100, once: bool = True) -> StreamingQuery:
    """Admit visits after the last visit of their profile, or at that time with a URL not seen then."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = _latest(spark, f"{cursor_path}/visits", n, VISIT_SCHEMA)
        seen = _latest(spark, f"{cursor_path}/boundary", n, BOUNDARY_SCHEMA)
        admitted, moved, keys = cursors.read_by_visit(batch, old, seen, backfill)
        _save(admitted, sink, n)
        _save(moved, f"{cursor_path}/visits", n)
        _save(keys, f"{cursor_path}/boundary", n)

    return _start(visits, each, state, once)


def without_repeats(records: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Drop records that an overlapping poll delivers again; state is kept for the watermark delay only."""
    timed = records.withColumn("seen_at", F.col("ts").cast("timestamp")).withWatermark("seen_at", delay)
    return timed.dropDuplicatesWithinWatermark(["channel", "record_number"]).drop("seen_at")


def append_rows(stream: DataFrame, sink: str, state: str, once: bool = True, one_batch: bool = False) -> StreamingQuery:
    """``one_batch``: all that is there in a single micro-batch. State with a time to live asks for micro-batches without
    data for ever, so a run that is to end needs it."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", state)
    if one_batch:
        writer = writer.trigger(once=True)
    else:
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEFAULT_INTERVAL)
    return writer.start()


def live_scores(events: DataFrame, baseline: Baseline, sink: str, state: str, once: bool = True) -> StreamingQuery:
    """Score new events against a learned baseline. Spark starts no batch when nothing new arrived."""
    settled = baseline.settled()

    def each(batch: DataFrame, n: int) -> None:
        _save(scoring.score(batch, settled), sink, n)

    return _start(events, each, state, once)


def live_sessions(events: DataFrame, window_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Runs of one device with gaps up to the window, put out once the watermark has passed their end.

    Sessions are merged inside each task before the shuffle, so a busy device shuffles a few rows per task.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = events.where("device <> ''").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    runs = timed.groupBy("device", F.session_window("at", f"{window_seconds} seconds")).agg(
        F.count("*").alias("n_events"), F.max("at").alias("end_time")
    )
    return runs.select(
        "device",
        F.col("session_window.start").cast("timestamp_ntz").alias("start_time"),
        F.col("end_time").cast("timestamp_ntz").alias("end_time"),
        "n_events",
    )


def live_counters(events: DataFrame, sink: str, state: str, once: bool = True) -> StreamingQuery:
    """Events and latest event time per source, kept up to date."""
    counts = events.groupBy("source").agg(F.count("*").alias("events"), F.max("ts").alias("last_event_time"))

    def each(batch: DataFrame, n: int) -> None:
        _save(batch, sink, n)

    return _start(counts, each, state, once, mode="complete")


def newest(spark: SparkSession, sink: str) -> DataFrame:
    """What the last micro-batch wrote to a sink that each batch replaces as a whole."""
    every = spark.read.parquet(sink)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(last, "batch").drop("batch")
