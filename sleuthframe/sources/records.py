"""Raw collector records to raw event rows, as column expressions over record tables.

Each function returns ``source, event_type, ts, description, severity, user, device, file_path, metadata`` plus
the key columns of its input; ``ts`` is null where the record has no usable time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import lookup, strip, text
from sleuthframe.functions.timestamps import hundred_ns_text, unix_epoch_micros, webkit_micros

# Log record type codes and levels.
WINDOWS_TYPE_LABELS = {1: "ERROR", 2: "WARNING", 4: "INFO", 8: "AUDIT_SUCCESS", 16: "AUDIT_FAILURE"}
LEVEL_LABELS = {1: "CRITICAL", 2: "ERROR", 3: "WARNING", 4: "INFO", 5: "VERBOSE"}
# Antivirus data names that also become top-level metadata keys.
LIFTED = {
    "Threat Name": "threat_name",
    "Threat ID": "threat_id",
    "Severity Name": "severity_name",
    "Category Name": "category_name",
    "Action Name": "action_name",
    "Action ID": "action_id",
    "Detection ID": "detection_id",
    "Process Name": "process_name",
    "Path": "path",
    "Detection User": "detection_user",
    "Origin Name": "origin_name",
    "Error Description": "error_description",
}
DEFENDER_CHANNEL = "Microsoft-Windows-Windows Defender/Operational"
# Watched file operations.
FILE_TYPES = {
    "created": "FILE_CREATED",
    "modified": "FILE_MODIFIED",
    "deleted": "FILE_DELETED",
    "moved": "FILE_RENAMED",
}
EVENT_FIELDS = ["source", "event_type", "ts", "description", "severity", "user", "device", "file_path", "metadata"]


def _json(**fields: Column) -> Column:
    """JSON object with sorted keys; null and '' are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def windows_events(records: DataFrame) -> DataFrame:
    """``channel, TimeGenerated, SourceName, EventID, EventType, EventCategory, RecordNumber, ComputerName, Sid,
    StringInserts, Message`` (message null when it was not rendered)."""
    event_id = F.col("EventID").bitwiseAND(65535)
    inserts = F.array_join(F.filter("StringInserts", lambda s: s.isNotNull() & (s != "")), " ")
    return records.select(
        F.col("channel"),
        F.col("RecordNumber").alias("record_number"),
        F.lit("Windows").alias("source"),
        event_id.cast("string").alias("event_type"),
        F.col("TimeGenerated").cast("timestamp_ntz").alias("ts"),
        F.coalesce("Message", inserts, F.lit("")).alias("description"),
        lookup(F.col("EventType"), WINDOWS_TYPE_LABELS, "INFO").alias("severity"),
        text("Sid").alias("user"),
        text("ComputerName").alias("device"),
        F.lit("").alias("file_path"),
        _json(
            provider=_filled(F.col("SourceName")),
            event_id=event_id,
            channel=F.col("channel"),
            event_category=F.col("EventCategory"),
            event_type_code=F.col("EventType"),
            record_number=F.col("RecordNumber"),
        ).alias("metadata"),
    )


DEFENDER_XML = (
    "System struct<Provider:struct<_Name:string>,EventID:string,Level:string,TimeCreated:struct<_SystemTime:string>,"
    "EventRecordID:string,Computer:string,Security:struct<_UserID:string>>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)


def defender_events(xml: DataFrame) -> DataFrame:
    """One rendered event per row in ``xml``; ``malformed`` marks text that is not XML."""
    e = xml.select("*", F.from_xml("xml", DEFENDER_XML).alias("e"))
    data = F.transform(
        F.coalesce("e.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
        lambda d, i: F.struct(
            F.coalesce(_filled(d["_Name"]), F.concat(F.lit("data_"), i.cast("string"))).alias("k"),
            strip(text(d["_VALUE"])).alias("v"),
        ),
    )
    number = strip("e.System.EventID")
    level_text = strip("e.System.Level")
    e = e.select(
        "*",
        F.map_from_entries(data).alias("data"),
        _filled(number).alias("event_id"),
        F.when(level_text.rlike(r"^\d+$"), level_text.cast("int")).alias("level"),
    )
    got = lambda name: _filled(F.col("data")[name])
    threat, action, path = got("Threat Name"), got("Action Name"), got("Path")
    said = F.concat(
        F.lit("Windows Defender detected threat: "),
        threat,
        F.when(action.isNotNull(), F.concat(F.lit(" (action: "), action, F.lit(")"))).otherwise(""),
        F.when(path.isNotNull(), F.concat(F.lit(" [path: "), path, F.lit("]"))).otherwise(""),
    )
    sorted_data = F.map_from_entries(F.array_sort(F.map_entries("data")))
    numeric = F.col("event_id").rlike(r"^\d+$")
    lifted = {meta: got(name) for name, meta in LIFTED.items()}
    key = [c for c in xml.columns if c != "xml"]
    return e.select(
        *key,
        (F.col("e").isNull() | (F.col("e.System").isNull() & F.col("e.EventData").isNull())).alias("malformed"),
        _filled(strip("e.System.EventRecordID")).alias("record_number"),
        F.lit("Defender").alias("source"),
        F.when(numeric, F.col("event_id").cast("bigint").cast("string")).otherwise(F.col("event_id")).alias("event_type"),
        hundred_ns_text(F.col("e.System.TimeCreated._SystemTime")).alias("ts"),
        F.coalesce(said, F.concat(F.lit("Windows Defender event "), F.coalesce("event_id", F.lit("None")))).alias(
            "description"
        ),
        F.coalesce(got("Severity Name"), lookup(F.col("level"), LEVEL_LABELS, "INFO")).alias("severity"),
        text("e.System.Security._UserID").alias("user"),
        strip(text("e.System.Computer")).alias("device"),
        F.coalesce(path, F.lit("")).alias("file_path"),
        _json(
            provider=_filled(F.col("e.System.Provider._Name")),
            event_id=F.when(numeric, F.col("event_id").cast("bigint").cast("variant")).otherwise(
                F.col("event_id").cast("variant")
            ),
            channel=F.lit(DEFENDER_CHANNEL),
            level=F.col("level"),
            record_number=_filled(strip("e.System.EventRecordID")),
            event_data=sorted_data,
            **lifted,
        ).alias("metadata"),
    )


def browser_events(history: DataFrame) -> DataFrame:
    """``browser, profile, family, url, title, visit_count, last_visit, device, user``; ``family`` is the history
    format, ``chromium`` (µs since 1601) or ``firefox`` (µs since 1970)."""
    url, title = strip(text("url")), strip(text("title"))
    ts = F.when(F.col("family") == "firefox", unix_epoch_micros(F.col("last_visit"))).otherwise(
        webkit_micros(F.col("last_visit"))
    )
    return history.select(
        "browser",
        "profile",
        F.lit("Browser").alias("source"),
        F.lit("BROWSER_VISIT").alias("event_type"),
        ts.alias("ts"),
        F.concat("browser", F.lit(" visited: "), F.coalesce(_filled(title), _filled(url), F.lit("(no title)"))).alias(
            "description"
        ),
        F.lit("INFO").alias("severity"),
        text("user").alias("user"),
        text("device").alias("device"),
        url.alias("file_path"),
        _json(
            browser=F.col("browser"),
            profile=F.col("profile"),
            url=_filled(url),
            title=_filled(title),
            visit_count=F.col("visit_count"),
        ).alias("metadata"),
    )


def newest_visits(history: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows per history; never-visited Firefox rows are skipped. Ties go to the smaller URL."""
    seen = history.where((F.col("family") != "firefox") | F.col("last_visit").isNotNull())
    order = W.partitionBy("browser", "profile").orderBy(F.col("last_visit").desc_nulls_last(), "url")
    return seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def file_events(records: DataFrame) -> DataFrame:
    """``operation, src_path, dest_path, is_directory, seen_at, device``; other operations are dropped."""
    kind = lookup(F.col("operation"), FILE_TYPES, None)
    src, dest = text("src_path"), text("dest_path")
    is_dir = F.coalesce("is_directory", F.lit(False))
    noun = F.when(is_dir, "Directory").otherwise("File")
    renamed = F.col("event_type") == "FILE_RENAMED"
    return (
        records.withColumn("event_type", kind)
        .where("event_type IS NOT NULL")
        .select(
            F.lit("FileSystem").alias("source"),
            "event_type",
            F.col("seen_at").alias("ts"),
            F.when(renamed, F.concat(noun, F.lit(" renamed from "), src, F.lit(" to "), dest))
            .otherwise(F.concat(noun, F.lit(" "), F.col("operation"), F.lit(": "), src))
            .alias("description"),
            F.lit("INFO").alias("severity"),
            F.lit("").alias("user"),
            text("device").alias("device"),
            F.when(renamed, F.coalesce(_filled(dest), src)).otherwise(src).alias("file_path"),
            _json(
                src_path=src,
                is_directory=is_dir,
                old_path=F.when(renamed, src),
                new_path=F.when(renamed, dest),
            ).alias("metadata"),
        )
    )


def usb_events(records: DataFrame) -> DataFrame:
    """``event_type, name, device_id, pnp_device_id, manufacturer, description, status, serial_number, seen_at,
    device, observed``; only ids that start with USB pass a live feed."""
    clean = lambda c: strip(text(c))
    device_id = strip(F.coalesce(_filled(F.col("device_id")), F.col("pnp_device_id"), F.lit("")))
    part = F.split(device_id, r"\\")
    instance = F.when(F.size(part) >= 3, F.element_at(part, -1)).otherwise("")
    serial = F.coalesce(_filled(clean("serial_number")), instance)
    hexid = lambda p: F.upper(F.regexp_extract(device_id, p + r"_([0-9A-Fa-f]{4})", 1))
    label = F.coalesce(
        _filled(clean("name")), _filled(clean("description")), _filled(device_id), F.lit("Unknown USB device")
    )
    verb = F.when(F.col("event_type") == "USB_CONNECTED", "connected").otherwise("disconnected")
    return records.select(
        F.lit("USB").alias("source"),
        "event_type",
        F.col("seen_at").alias("ts"),
        F.concat(F.lit("USB device "), verb, F.lit(": "), label).alias("description"),
        F.lit("INFO").alias("severity"),
        F.lit("").alias("user"),
        text("device").alias("device"),
        F.lit("").alias("file_path"),
        _json(
            device_name=_filled(clean("name")),
            device_id=_filled(device_id),
            pnp_device_id=_filled(device_id),
            manufacturer=_filled(clean("manufacturer")),
            description=_filled(clean("description")),
            status=_filled(clean("status")),
            serial_number=_filled(serial),
            vendor_id=_filled(hexid("VID")),
            product_id=_filled(hexid("PID")),
            capture=F.when(F.col("observed"), "realtime").otherwise("current_state"),
        ).alias("metadata"),
    )


def usb_only(records: DataFrame) -> DataFrame:
    return records.where(F.upper(strip(F.coalesce("pnp_device_id", F.lit("")))).startswith("USB"))


def newest_since(events: DataFrame, n: int, since=None, channel: str = "channel", order: str = "record_number") -> DataFrame:
    """Newest ``n`` per channel, not older than ``since``."""
    rows = events if since is None else events.where(F.col("ts") >= F.lit(since))
    newest = W.partitionBy(channel).orderBy(F.col("ts").desc(), F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def union_sources(batches: dict[str, DataFrame], wanted: Iterable[str] | None = None) -> DataFrame:
    """Chosen collectors as one table; names are case-insensitive, unknown names are ignored."""
    names = list(batches) if wanted is None else [n for n in dict.fromkeys(str(w).lower() for w in wanted) if n in batches]
    if not names:
        raise ValueError("no known source chosen")
    out = batches[names[0]].select(*EVENT_FIELDS)
    for name in names[1:]:
        out = out.unionByName(batches[name].select(*EVENT_FIELDS))
    return out
