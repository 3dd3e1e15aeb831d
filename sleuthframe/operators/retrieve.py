"""Filtered reads of the event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import text
from sleuthframe.vocabulary import KNOWN_SEVERITIES, TEXT_COLUMNS

DEFAULT_LIMIT = 100


def scan(events: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows in time order; with a limit, the oldest ones."""
    ordered = events.orderBy("ts", "id")
    return ordered if limit is None else ordered.limit(limit)


def by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("id") == event_id)


def public(events: DataFrame) -> DataFrame:
    """Stored row without the hash columns; null text reads as ''."""
    return events.select("id", "ts", *[text(c).alias(c) for c in TEXT_COLUMNS])


def known_severity(severity: str) -> str:
    name = severity.strip().upper()
    if name not in KNOWN_SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    return name


def where_equal(
    events: DataFrame,
    source: str | None = None,
    event_type: str | None = None,
    severity: str | None = None,
    user: str | None = None,
    device: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """AND of the given exact filters and an inclusive time range."""
    out = events
    exact = {"source": source, "event_type": event_type, "user": user, "device": device}
    if severity is not None:
        exact["severity"] = known_severity(severity)
    for name, value in exact.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def page(events: DataFrame, limit: int = 100, offset: int = 0, newest_first: bool = False, **filters) -> DataFrame:
    """One page of filtered rows. For deep pages use ``page_after``, which does not sort what it skips."""
    order = [F.col("ts").desc(), F.col("id").desc()] if newest_first else [F.col("ts"), F.col("id")]
    return public(where_equal(events, **filters).orderBy(*order).offset(offset).limit(limit))


def page_with_total(events: DataFrame, limit: int = 100, offset: int = 0, newest_first: bool = False, **filters) -> DataFrame:
    """A page whose rows also tell how many rows the filters match; the rows are counted once, not sorted."""
    total = where_equal(events, **filters).agg(F.count("*").alias("total")).scalar()
    return page(events, limit, offset, newest_first, **filters).withColumn("total", total)


def page_after(events: DataFrame, last_ts: dt.datetime, last_id: int, limit: int = 100, **filters) -> DataFrame:
    """Next page after a known row: the filter reaches the scan."""
    t = F.lit(last_ts).cast("timestamp_ntz")
    rest = where_equal(events, **filters).where((F.col("ts") > t) | ((F.col("ts") == t) & (F.col("id") > last_id)))
    return public(rest.orderBy("ts", "id").limit(limit))


def contains(column: Column, needle: str | Column) -> Column:
    """Literal, case-insensitive substring test."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(column), F.lower(n))


def keyword_hit(needle: str | Column) -> Column:
    """The keyword occurs in the description, the path or the metadata."""
    return contains(text("description"), needle) | contains(text("file_path"), needle) | contains(text("metadata"), needle)


def retrieve(
    events: DataFrame,
    sources: Sequence[str] = (),
    event_types: Sequence[str] = (),
    keywords: Sequence[str] = (),
    user: str | None = None,
    device: str | None = None,
    file_path: str | None = None,
    severity: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    hours: tuple[int, int] | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Oldest matching rows up to the limit, with ``truncated`` telling whether the limit was reached."""
    if limit <= 0:
        raise ValueError("limit must be a positive integer")
    if hours is not None and not (0 <= hours[0] <= hours[1] <= 23):
        raise ValueError("hours must be two ordered values between 0 and 23")
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    out = where_equal(events, severity=severity, user=user, device=device, start=start, end=end)
    if sources:
        out = out.where(F.col("source").isin(*dict.fromkeys(sources)))
    if event_types:
        out = out.where(F.col("event_type").isin(*dict.fromkeys(event_types)))
    if file_path:
        out = out.where(contains(F.col("file_path"), file_path))
    for word in dict.fromkeys(keywords):
        out = out.where(keyword_hit(word))
    if hours is not None:
        out = out.where(F.hour("ts").between(*hours))
    found = out.orderBy("ts", "id").limit(limit)
    # At most ``limit`` rows are left here, so counting them over one window is a bounded step.
    return found.withColumn("truncated", F.count("*").over(W.partitionBy()) >= limit)


def recent(events: DataFrame, n: int = 10) -> DataFrame:
    return public(events.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n))


def related(events: DataFrame, selected: DataFrame, n: int = 15) -> DataFrame:
    """Ids of the newest ``n`` events of the same source, without the event itself, per selected event.

    The newest rows are one short array per source, so joining them on a hot source moves no pair of events.
    """
    newest = W.partitionBy("source").orderBy(F.col("ts").desc(), F.col("id").desc())
    top = events.select("source", "ts", "id").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    lists = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_top"))
    ids = F.filter(F.col("_top.id"), lambda x: x != F.col("id"))
    return selected.join(lists, "source").select("id", "source", ids.alias("related_ids"))
