"""Live incidents: components of links that grow, merge and are revised as events arrive.

State is a table of compacted rows (see ``operators.correlate.compact``), each with the component it belongs to. All rows of a
component were written by one micro-batch, its birth. A new micro-batch can only link to rows of the same or a neighbouring
time cell that have the same device, or where one side has none. The components of such rows are taken out of the state,
joined with the new rows and correlated anew; what they were is marked as dropped. No other component can change, so after any
sequence of micro-batches the incidents equal those of one correlation over all events, however late an event comes, also
an event without a device that joins two incidents of different devices.

Each micro-batch writes folders of its own batch id below ``path``: ``groups``, ``dropped``, ``incidents`` and at last
``commits``. A micro-batch that is repeated after a failure replaces its own folders and reads only earlier ones; readers see
committed micro-batches only. State is sorted by cell, so the search for neighbours skips files by their cells, and whole
components are read from the micro-batches that bore them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sleuthframe.operators import correlate as c
from sleuthframe.session import cut_lineage, passing_tables
from sleuthframe.streaming.jobs import _save, _start


def _stored(spark: SparkSession, path: str, name: str, before: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch") < before)


def _alive(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of components that no later micro-batch took out."""
    gone = dropped.select(F.col("comp"), F.col("born").alias("batch"))
    return rows.join(gone, ["comp", "batch"], "left_anti")


def _touched(new: DataFrame, groups: DataFrame, dropped: DataFrame) -> DataFrame:
    """(comp, born) of the components that some new row may be linked to."""
    span = new.agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).first()
    if span["lo"] is None:
        return groups.limit(0).select("comp", F.col("batch").alias("born"))
    near = groups.where(F.col("cell").between(span["lo"] - 1, span["hi"] + 1)).select("device", "cell", "comp", "batch")
    near = _alive(near, dropped)
    around = new.select("device", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    bare = F.col("device") == ""
    same_device = near.join(around.where(~bare), ["device", "cell"], "left_semi")
    to_bare = near.where(bare).join(around.select("cell").distinct(), "cell", "left_semi")
    from_bare = near.join(around.where(bare).select("cell"), "cell", "left_semi")
    columns = ["comp", F.col("batch").alias("born")]
    return same_device.select(*columns).unionByName(to_bare.select(*columns)).unionByName(from_bare.select(*columns)).distinct()


def advance(events: DataFrame, path: str, batch: int, window_seconds: float = 300, min_group_size: int = 2) -> None:
    """Work one micro-batch of events into the state below ``path``."""
    spark = events.sparkSession
    rows = c._with_cell(c.features(events), c._window_us(window_seconds))
    new = cut_lineage(c.compact(rows, []))
    if batch == 0:
        found = c.correlate_groups(new, window_seconds, min_group_size)
        touched = found.groups.limit(0).select("comp", F.lit(0).alias("born"))
        revised = found.incidents.withColumns({"revision": F.lit(1), "replaces": F.array().cast("array<string>")})
    else:
        groups = _stored(spark, path, "groups", batch)
        dropped = _stored(spark, path, "dropped", batch)
        touched = cut_lineage(_touched(new, groups, dropped))
        old = cut_lineage(groups.withColumnRenamed("batch", "born").join(touched, ["comp", "born"]))
        affected = c.recompact(old.select(*new.columns).unionByName(new), [])
        found = c.correlate_groups(affected, window_seconds, min_group_size)
        revised = _revised(found, old, _stored(spark, path, "incidents", batch))
    _save(found.groups.repartitionByRange("cell").sortWithinPartitions("cell"), f"{path}/groups", batch)
    _save(touched, f"{path}/dropped", batch)
    _save(revised, f"{path}/incidents", batch)
    _save(spark.range(1).select(F.current_timestamp().alias("at")), f"{path}/commits", batch)


def _revised(found: c.Correlation, old: DataFrame, incidents: DataFrame) -> DataFrame:
    """The new incidents with their revision and the earlier incidents whose place they take.

    The place of an incident is taken by those that hold some of its rows; an incident that stays as it was keeps its revision.
    """
    before = incidents.select("comp", F.col("batch").alias("born"), F.col("incident_id").alias("old_id"), F.col("revision").alias("old_revision"))
    # Groups have texts and nulls in their keys; a hash of all of them meets on one column.
    key = F.sha2(F.to_json(F.struct(*c.ALIKE)), 256).alias("key")
    here = found.groups.select(key, "comp")
    moved = old.select(key, F.col("comp").alias("old_comp"), "born").join(here, "key").select("comp", "old_comp", "born").distinct()
    came = moved.join(before.withColumnRenamed("comp", "old_comp"), ["old_comp", "born"])
    came = came.select("comp", "old_id", "old_revision").distinct()
    history = came.groupBy("comp").agg(
        F.max("old_revision").alias("last"), F.array_sort(F.collect_set("old_id")).alias("olds")
    )
    both = found.incidents.join(history, "comp", "left")
    same = F.coalesce(F.array_contains("olds", F.col("incident_id")), F.lit(False))
    replaces = F.coalesce(F.array_remove("olds", F.col("incident_id")), F.array().cast("array<string>"))
    revision = F.coalesce(F.col("last") + F.when(same & (F.size(replaces) == 0), 0).otherwise(1), F.lit(1))
    return both.withColumns({"revision": revision, "replaces": replaces}).drop("last", "olds")


def live_incidents(
    events: DataFrame, path: str, state: str, window_seconds: float = 300, min_group_size: int = 2, once: bool = True
) -> StreamingQuery:
    """Follow a stream of events; ``current`` and ``changes`` read what it has found."""

    def each(batch: DataFrame, n: int) -> None:
        with passing_tables(batch.sparkSession):
            advance(batch, path, n, window_seconds, min_group_size)

    return _start(events, each, state, once)


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    commits = spark.read.parquet(f"{path}/commits").select("batch").distinct()
    return spark.read.parquet(f"{path}/{name}").join(commits, "batch", "left_semi")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The incidents as they stand after the last committed micro-batch."""
    return _alive(_committed(spark, path, "incidents"), _committed(spark, path, "dropped").drop("batch")).drop("comp", "batch")


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(batch, incident_id, what, revision): every incident when it came up, and when it was retracted.

    Incidents that a micro-batch looked at again and left as they were don't appear.
    """
    every = _committed(spark, path, "incidents").select("comp", "batch", "incident_id", "revision")
    gone = _committed(spark, path, "dropped").select("comp", F.col("born").alias("batch"), F.col("batch").alias("at"))
    out = every.join(gone, ["comp", "batch"]).select(F.col("at").alias("batch"), "incident_id", "revision")
    came = every.select("batch", "incident_id", "revision")
    same = ["batch", "incident_id"]
    added = came.join(out.select(*same), same, "left_anti").withColumn("what", F.lit("found"))
    retracted = out.join(came.select(*same), same, "left_anti").withColumn("what", F.lit("retracted"))
    columns = ["batch", "incident_id", "what", "revision"]
    return added.select(*columns).unionByName(retracted.select(*columns))
