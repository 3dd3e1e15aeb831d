"""Registered streaming queries. Rows arrive poll by poll; the stream works off each poll before the next one is written."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sleuthframe.operators import chain, hashtree
from sleuthframe.operators.baseline import learn
from sleuthframe.operators.cursors import profile_key, url_key
from sleuthframe.plans import derived
from sleuthframe.plans.catalog import incident_columns, query
from sleuthframe.session import checkpoint_root
from sleuthframe.sources.activity import activity_events
from sleuthframe.sources.records import browser_events
from sleuthframe.streaming import incidents, jobs, keyed, ledger, profiles


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def _polls(df: DataFrame, poll, at: str, n: int, start: Callable[[], StreamingQuery]) -> None:
    """Deliver the rows of each poll, in order and in their natural partitions, and run the stream after each.

    The rows are computed once and laid out by poll.
    """
    spark = df.sparkSession
    dealt = df.withColumn("_poll", poll.cast("int"))
    dealt.write.partitionBy("_poll").parquet(f"{at}/polls")
    staged = spark.read.schema(dealt.schema).parquet(f"{at}/polls")
    for i in range(n):
        staged.where(F.col("_poll") == i).drop("_poll").write.mode("append").parquet(f"{at}/in")
        start().awaitTermination()


def _slice(ts, n: int):
    """Poll number of a time: n equal parts of the 30 days that the data covers."""
    day = F.datediff(ts, F.lit(dt.date(2024, 1, 1)))
    return F.least(F.greatest(F.floor(day * n / 30), F.lit(0)), F.lit(n - 1))


@query
def stream_ingest(spark, d):
    at = _folder(spark)

    def start():
        return jobs.ingest(jobs.watch(spark, f"{at}/in", jobs.RAW_SCHEMA), f"{at}/out", f"{at}/state")

    _polls(derived.raw_json(spark, d), F.col("batch_pos") % 3, at, 3, start)
    return spark.read.parquet(f"{at}/out").drop("batch")


def _overlapping(rows: DataFrame, at: str, start: Callable[[], StreamingQuery], n: int = 5) -> None:
    """Each poll also delivers again what the poll before it delivered in its last day."""
    again = rows.withColumn("poll", _slice(F.col("ts"), n))
    late = again.withColumn("next", _slice(F.date_add(F.col("ts"), 1), n)).where("next > poll").withColumn("poll", F.col("next")).drop("next")
    both = again.unionByName(late)
    _polls(both.select(*rows.columns, F.col("poll").alias("_at")), F.col("_at"), at, n, start)


@query
def stream_hwm(spark, d):
    at = _folder(spark)
    records, _ = derived.polled_records(spark, d)

    def start():
        stream = jobs.watch(spark, f"{at}/in", records.schema)
        return jobs.follow_records(stream, f"{at}/out", f"{at}/cursors", f"{at}/state", backfill=None)

    _overlapping(records, at, start)
    return spark.read.parquet(f"{at}/out").select("channel", "record_number", "ts")


@query
def stream_dedup(spark, d):
    at = _folder(spark)
    records, _ = derived.polled_records(spark, d)

    def start():
        stream = jobs.without_repeats(jobs.watch(spark, f"{at}/in", records.schema), "3 days")
        return jobs.append_rows(stream, f"{at}/out", f"{at}/state")

    _overlapping(records, at, start)
    return spark.read.parquet(f"{at}/out").select("channel", "record_number", "ts")


@query
def stream_browser(spark, d):
    at = _folder(spark)
    visits = browser_events(derived.browser_history(spark, d)).select(
        profile_key(F.col("browser"), F.col("profile")).alias("profile_key"),
        F.date_trunc("DAY", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
        F.col("file_path").alias("url"),
    ).where("ts IS NOT NULL").distinct()

    def start():
        stream = jobs.watch(spark, f"{at}/in", visits.schema)
        return jobs.follow_visits(stream, f"{at}/out", f"{at}/cursors", f"{at}/state", backfill=None)

    _overlapping(visits, at, start)
    return spark.read.parquet(f"{at}/out").select("profile_key", "ts", "url")


# Polls in the order of their arrival: the second one comes late, the last two come at once, in the wrong order.
LATE_POLLS = [[0], [2], [1], [4, 3]]


def _late(rows: DataFrame, at: str, start: Callable[[DataFrame], DataFrame], n: int = 5) -> DataFrame:
    """Result of a stream whose polls overlap and come out of order; the query is started anew for each arrival."""
    spark = rows.sparkSession
    own = rows.withColumn("poll", _slice(F.col("ts"), n).cast("int"))
    late = own.withColumn("next", _slice(F.date_add(F.col("ts"), 1), n).cast("int")).where("next > poll")
    both = own.unionByName(late.withColumn("poll", F.col("next")).drop("next"))
    both.withColumn("_poll", F.col("poll")).write.partitionBy("_poll").parquet(f"{at}/polls")
    staged = spark.read.schema(f"{_ddl(both)}, _poll int").parquet(f"{at}/polls")
    for arrival in LATE_POLLS:
        staged.where(F.col("_poll").isin(arrival)).drop("_poll").coalesce(1).write.mode("append").parquet(f"{at}/in")
        found = start(jobs.watch(spark, f"{at}/in", both.schema))
        jobs.append_rows(found.drop("poll"), f"{at}/out", f"{at}/state", one_batch=True).awaitTermination()
    return spark.read.parquet(f"{at}/out")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@query
def stream_record_state(spark, d):
    """Cursors as keyed state; an earlier run has read the first half of one channel."""
    at = _folder(spark)
    records, cursors = derived.polled_records(spark, d)
    start = cursors.where("channel = 'Channel0'")
    return _late(records, at, lambda s: keyed.new_records(s, start, backfill=None, poll="poll"))


@query
def stream_visit_state(spark, d):
    """Visits by keyed state; an earlier run has read one profile up to a day, and some visits of that day."""
    at = _folder(spark)
    visits = derived.polled_visits(spark, d)[0].where("ts IS NOT NULL")
    day = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    known = visits.where("profile_key = 'Edge::P1'")
    cursors = known.select("profile_key", day.alias("last_visit")).distinct()
    boundary = known.where((F.col("ts") == day) & (F.length("url") % 2 == 0)).select("profile_key", url_key(F.col("url")).alias("url_key"))
    return _late(visits, at, lambda s: keyed.new_visits(s, cursors, boundary, backfill=None, poll="poll"))


@query
def stream_scores(spark, d):
    at = _folder(spark)
    e = activity_events(spark, d, missing_devices=True)
    past = e.where((F.col("ts") < F.lit(dt.datetime(2024, 1, 8)).cast("timestamp_ntz")) & (F.col("source") != "USB"))
    baseline = learn(past).settled()

    def start():
        return jobs.live_scores(jobs.watch(spark, f"{at}/in", e.schema), baseline, f"{at}/out", f"{at}/state")

    _polls(e, _slice(F.col("ts"), 3), at, 3, start)
    out = spark.read.parquet(f"{at}/out")
    return out.select("id", "anomaly_score", "classification", "severity", F.array_join("signals", "|").alias("signals"))


@query
def stream_incidents(spark, d):
    """Live sessions of at least two events. One event far in the future moves the watermark past all real ones."""
    at = _folder(spark)
    e = activity_events(spark, d).select("id", "ts", "device")

    def start():
        runs = jobs.live_sessions(jobs.watch(spark, f"{at}/in", e.schema))
        return jobs.append_rows(runs, f"{at}/out", f"{at}/state")

    _polls(e, _slice(F.col("ts"), 3), at, 3, start)
    last = e.agg(
        F.lit(0).cast("bigint").alias("id"),
        (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
        F.lit("flush").alias("device"),
    )
    last.write.mode("append").parquet(f"{at}/in")
    start().awaitTermination()
    return spark.read.parquet(f"{at}/out").where("n_events >= 2")


@query
def stream_counters(spark, d):
    at = _folder(spark)
    e = activity_events(spark, d).select("id", "ts", "source")

    def start():
        return jobs.live_counters(jobs.watch(spark, f"{at}/in", e.schema), f"{at}/out", f"{at}/state")

    _polls(e, _slice(F.col("ts"), 3), at, 3, start)
    return jobs.newest(spark, f"{at}/out")


@query
def stream_incidents_revised(spark, d):
    """Live incidents as they stand at last; many rows without a device come a poll late and join what stood apart."""
    at = _folder(spark)
    e = activity_events(spark, d, missing_devices=True)
    late = (F.col("device") == "") & (F.col("id") % 2 == 0)
    poll = _slice(F.col("ts"), 2) + late.cast("int")

    def start():
        return incidents.live_incidents(jobs.watch(spark, f"{at}/in", e.schema), f"{at}/out", f"{at}/state")

    _polls(e, poll, at, 3, start)
    return incident_columns(incidents.current(spark, f"{at}/out"))


def _ledger(spark: SparkSession, d: str) -> str:
    """A ledger of raw records that came in three polls."""
    at = _folder(spark)

    def start():
        return ledger.ingest_ledger(jobs.watch(spark, f"{at}/in", jobs.RAW_SCHEMA), f"{at}/out", f"{at}/state", segment_rows=derived.QUERY_SEGMENT)

    _polls(derived.raw_json(spark, d), F.col("batch_pos") % 3, at, 3, start)
    return f"{at}/out"


@query
def stream_ledger(spark, d):
    return ledger.events(spark, _ledger(spark, d)).select("id", "ts", "source", "event_type", "description", "file_path", "chain")


@query
def stream_ledger_stats(spark, d):
    at = _ledger(spark, d)
    stats = ledger.statistics(spark, at)
    reasons = ledger.committed(spark, at, "rejects").groupBy("reason").agg(F.count("*").alias("inserted"))
    return stats.drop("last_event_time").unionByName(reasons.withColumnRenamed("reason", "source"), allowMissingColumns=True)


@query
def stream_ledger_check(spark, d):
    rows = ledger.events(spark, _ledger(spark, d))
    return chain.verify(rows, "chain", stored_tree=hashtree.tree(rows))


@query
def stream_rolling_baseline(spark, d):
    """Scores by the counts that a stream has kept of fifteen days; half of its polls are squashed on the way."""
    at = _folder(spark)
    e = activity_events(spark, d, missing_devices=True)
    polls = []

    def start():
        if len(polls) == 2:
            profiles.squash(spark, f"{at}/out")
        polls.append(1)
        return profiles.follow_profile(jobs.watch(spark, f"{at}/in", e.schema), f"{at}/out", f"{at}/state")

    _polls(e, F.col("id") % 3, at, 3, start)
    found, _ = profiles.score_when_new(e, f"{at}/out", -1, dt.date(2024, 1, 5), dt.date(2024, 1, 19))
    return found.select("id", "anomaly_score", "classification", "severity", F.array_join("signals", "|").alias("signals"))
