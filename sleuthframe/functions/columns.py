"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sleuthframe.vocabulary import RELATED_CATEGORIES, SEVERITY_RANK, SEVERITY_WEIGHT


def text(col: str | Column) -> Column:
    """Null text reads as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# Fixed value: characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: str | Column) -> Column:
    """Text without white space at both ends, tabs and line ends included."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def lookup(col: Column, table: Mapping, default) -> Column:
    """Literal map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default))


def micros(ts: Column) -> Column:
    """Microseconds since 1970; the session time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    """ISO-8601 text without a fraction when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def category(source: Column, event_type: Column) -> Column:
    """Coarse activity category; the first rule that holds wins."""
    kind = F.upper(event_type)
    return (
        F.when((source == "USB") | kind.startswith("USB_"), "usb")
        .when((source == "FileSystem") | kind.startswith("FILE_"), "file")
        .when((source == "Browser") | (kind == "BROWSER_VISIT"), "browser")
        .when(source == "Defender", "defender")
        .when(source == "Windows", "windows")
        .otherwise("other")
    )


def norm_path(path: Column) -> Column:
    return F.lower(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def parent_dir(normalized: Column) -> Column:
    """Text before the last slash, '' without one."""
    return F.regexp_extract(normalized, r"(?s)^(.*)/", 1)


def severity_rank(severity: Column) -> Column:
    return lookup(F.upper(severity), SEVERITY_RANK, 0)


def severity_weight(severity: Column) -> Column:
    return lookup(F.upper(severity), SEVERITY_WEIGHT, 0)


def related_reason(a: str, b: str) -> str | None:
    """Reason text for two categories, or None when they are not related."""
    if (a, b) not in RELATED_CATEGORIES and (b, a) not in RELATED_CATEGORIES:
        return None
    if a == b:
        return f"related {a} events"
    lo, hi = sorted((a, b))
    return f"known event-type relationship ({lo} + {hi})"


def canonical_json(previous_hash: Column, ts: str = "ts") -> Column:
    """Row text that the chain hashes: sorted keys, compact, nulls as ''."""
    return F.to_json(
        F.struct(
            text("description").alias("description"),
            text("device").alias("device"),
            text("event_type").alias("event_type"),
            text("file_path").alias("file_path"),
            text("metadata").alias("metadata"),
            text(previous_hash).alias("previous_hash"),
            text("severity").alias("severity"),
            text("source").alias("source"),
            text(iso(F.col(ts))).alias("timestamp"),
            text("user").alias("user"),
        )
    )


def row_hash(previous_hash: Column) -> Column:
    return F.sha2(canonical_json(previous_hash), 256)


def reference_text(event_id: Column) -> Column:
    return F.when(event_id.isNotNull(), F.concat(F.lit("event "), event_id.cast("string"))).otherwise(
        "an event with no database id"
    )
