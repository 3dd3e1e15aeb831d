"""Timestamps from text or epoch numbers; nothing is ever replaced by the current time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sleuthframe.functions.columns import strip

ISO_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?( ?(Z|[+-]\d{2}:\d{2}))?$"
# Basic date and time without separators, and zones without a colon or without minutes.
BASIC_TEXT = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})"
SHORT_ZONE = r"(:\d{1,2}(?:\.\d+)?) ?([+-]\d{2})(\d{2})$"
HOUR_ZONE = r"(:\d{1,2}(?:\.\d+)?) ?([+-]\d{2})$"
SLASH_TEXT = r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
US_TEXT = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"


def parse_text(value: Column, us_dates: bool) -> Column:
    """ISO and slash forms; ``us_dates`` also takes month/day/year. Zoned text becomes UTC.

    Only text in none of these forms is rewritten, so the replacements are not made for every row.
    """
    bare = strip(value)
    parsed = F.when(bare.rlike(ISO_TEXT), bare.try_cast("timestamp")).when(
        bare.rlike(SLASH_TEXT), F.try_to_timestamp(bare, F.lit("y/M/d H:m:s"))
    )
    if us_dates:
        parsed = parsed.when(bare.rlike(US_TEXT), F.try_to_timestamp(bare, F.lit("M/d/y H:m:s")))
    v = F.regexp_replace(bare, BASIC_TEXT, "$1-$2-$3T$4:$5:$6")
    v = F.regexp_replace(F.regexp_replace(v, SHORT_ZONE, "$1$2:$3"), HOUR_ZONE, "$1$2:00")
    return parsed.otherwise(F.when(v.rlike(ISO_TEXT), v.try_cast("timestamp"))).cast("timestamp_ntz")


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds; null outside the years 1 to 9999."""
    ok = (seconds > -62135596800) & (seconds < 253402300800)
    return F.when(ok, F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))).cast("timestamp_ntz")


def strict(value: Column) -> Column:
    """For ingest: a null result means that the record is rejected."""
    return parse_text(value, us_dates=True)


def lenient(value: Column) -> Column:
    """For analysis: a null result keeps the row without a time."""
    return parse_text(value, us_dates=False)


def from_variant(value: Column) -> Column:
    """Strict time of a JSON value: text by its form, a number as epoch seconds, anything else null."""
    kind = F.schema_of_variant(value)
    number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(kind == "STRING", strict(F.try_variant_get(value, "$", "string"))).when(
        number, from_epoch(F.try_variant_get(value, "$", "double"))
    )


def webkit_micros(value: Column) -> Column:
    """Microseconds since 1601; zero and null are no time."""
    offset = 11644473600000000
    v = value.cast("bigint")
    ok = v.isNotNull() & (v != 0) & (v - offset).between(-62135596800000000, 253402300799999999)
    return F.when(ok, F.timestamp_micros(v - F.lit(offset))).cast("timestamp_ntz")


def unix_epoch_micros(value: Column) -> Column:
    """Microseconds since 1970; zero and null are no time."""
    v = value.cast("bigint")
    ok = v.isNotNull() & (v != 0) & v.between(-62135596800000000, 253402300799999999)
    return F.when(ok, F.timestamp_micros(v)).cast("timestamp_ntz")


def hundred_ns_text(value: Column) -> Column:
    """Log time text with up to seven fraction digits and an optional trailing Z."""
    bare = F.regexp_replace(strip(value), r"Z$", "")
    return F.when(bare.rlike(ISO_TEXT), bare.try_cast("timestamp")).cast("timestamp_ntz")
