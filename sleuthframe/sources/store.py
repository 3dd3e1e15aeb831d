"""Event store: append sink, additive schema and ordered reads over parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.vocabulary import EVENT_COLUMNS, EVENT_SCHEMA


def append(events: DataFrame, path: str) -> None:
    """Append rows, partitioned by event date so that time filters prune folders.

    Rebalancing brings a date together in few files and splits a date that is too large for one task.
    """
    rows = events.select(*[F.col(c) for c in EVENT_COLUMNS], F.to_date("ts").alias("event_date"))
    rows.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_stored_schema()).parquet(path)


def _stored_schema():
    from pyspark.sql import types as T

    return T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])


def with_legacy(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Union with rows from before hashing; columns they lack are null."""
    return current.unionByName(legacy, allowMissingColumns=True)
