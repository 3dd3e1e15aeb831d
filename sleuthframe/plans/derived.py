"""Input tables that Spark derives from the given tables: raw records, questions, requests, stored chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.functions.columns import iso, micros, text
from sleuthframe.operators.chain import build_chain, segment
from sleuthframe.sources.activity import activity_events, read_table

QUERY_SEGMENT = 256


def _source(e: DataFrame, name: str) -> DataFrame:
    return e.where(F.col("source") == name)


def _k():
    return F.get_json_object("metadata", "$.k").cast("int")


def raw_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one loose JSON record: each source uses its own key names, some records are unusable."""
    e = activity_events(spark, folder).withColumn("k", _k())
    t = iso(F.col("ts"))
    is_ = lambda s: F.col("source") == s
    when = lambda cond, c: F.when(cond, c)
    fields = F.struct(
        when(is_("Windows"), t).alias("TimeGenerated"),
        when(is_("Browser"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("visit_time"),
        when(is_("FileSystem") & (F.col("k") != 7), F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).alias("time"),
        when(is_("Defender"), F.when(F.col("k") == 3, "yesterday").otherwise(t)).alias("event_time"),
        when(is_("USB"), F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts"),
        when(~is_("Windows") & (F.col("k") != 11), F.col("source")).alias("source"),
        when(is_("Windows"), F.col("source")).alias("log_source"),
        when(is_("Windows") | is_("Defender"), F.col("event_type").try_cast("int")).alias("EventID"),
        when(~is_("Windows") & ~is_("Defender"), F.col("event_type")).alias("type"),
        when(is_("Browser"), F.when(F.col("k") == 5, "  ").otherwise(F.col("description"))).alias("title"),
        when(~is_("Browser"), F.col("description")).alias("message"),
        F.when(is_("USB"), "").otherwise(F.col("severity")).alias("level"),
        when(F.col("user") != "", F.col("user")).alias("account"),
        F.col("device").alias("computer"),
        when(is_("Browser"), F.col("file_path")).alias("url"),
        when(~is_("Browser"), F.col("file_path")).alias("path"),
        F.col("k").alias("k"),
        F.lit("").alias("note"),
        when(is_("Defender"), F.struct((F.col("k") % 5).alias("zone"), F.lit("agent").alias("by"))).alias("metadata"),
    )
    return e.select(F.col("id").alias("batch_pos"), F.to_json(fields).alias("raw"))


def windows_records(spark: SparkSession, folder: str) -> DataFrame:
    e = _source(activity_events(spark, folder), "Windows")
    code = F.when(F.col("severity") == "AUDIT_FAILURE", 16).when(_k() % 7 == 0, 2).when(_k() % 5 == 0, 3).otherwise(8)
    return e.select(
        F.concat(F.lit("Channel"), (F.col("id") % 3).cast("string")).alias("channel"),
        F.col("ts").alias("TimeGenerated"),
        F.lit("Auditing").alias("SourceName"),
        (F.col("event_type").cast("bigint") + F.lit(3221225472)).alias("EventID"),
        code.alias("EventType"),
        F.when(_k() % 4 != 0, _k() % 4).alias("EventCategory"),
        F.col("id").alias("RecordNumber"),
        F.col("device").alias("ComputerName"),
        F.when(_k() % 3 != 0, F.concat(F.lit("S-1-5-"), "user")).alias("Sid"),
        F.array(F.col("user"), F.lit(""), F.lit(None).cast("string"), F.col("device")).alias("StringInserts"),
        F.when(_k() % 2 == 0, F.col("description")).alias("Message"),
    )


def defender_xml(spark: SparkSession, folder: str) -> DataFrame:
    e = _source(activity_events(spark, folder), "Defender")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("7Z"))
    data = F.concat(
        F.lit('<Data Name="Threat Name">'), F.concat(F.lit("Threat.K"), _k().cast("string")), F.lit("</Data>"),
        F.when(_k() % 2 == 0, F.lit('<Data Name="Severity Name">Severe</Data>')).otherwise(""),
        F.when(_k() % 3 == 0, F.lit('<Data Name="Action Name">Quarantine</Data>')).otherwise(""),
        F.lit('<Data Name="Path">'), F.col("file_path"), F.lit("</Data>"),
        F.lit("<Data>extra</Data>"),
    )
    body = F.when(_k() % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("<EventData>"), data, F.lit("</EventData>")))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Guard"/><EventID>'),
        F.col("event_type"), F.lit("</EventID><Level>"), (_k() % 6).cast("string"),
        F.lit('</Level><TimeCreated SystemTime="'), stamp, F.lit('"/><EventRecordID>'), F.col("id").cast("string"),
        F.lit("</EventRecordID><Computer>"), F.col("device"), F.lit('</Computer><Security UserID="'), F.col("user"),
        F.lit('"/></System>'), body, F.lit("</Event>"),
    )
    return e.select("id", F.when(_k() == 17, F.lit("<Event><broken")).otherwise(xml).alias("xml"))


def browser_history(spark: SparkSession, folder: str) -> DataFrame:
    """History rows of three browsers; some rows have no title or no visit time."""
    e = _source(activity_events(spark, folder), "Browser")
    b = F.element_at(F.array(*[F.lit(x) for x in ("Chrome", "Edge", "Firefox")]), (F.col("id") % 3 + 1).cast("int"))
    us = micros(F.col("ts"))
    epoch = F.when(b == "Firefox", us).otherwise(us + F.lit(11644473600000000))
    return e.select(
        b.alias("browser"),
        F.concat(F.lit("P"), (_k() % 4).cast("string")).alias("profile"),
        F.when(b == "Firefox", "firefox").otherwise("chromium").alias("family"),
        F.col("file_path").alias("url"),
        F.when(_k() % 3 == 0, F.lit(None).cast("string"))
        .when(_k() % 3 == 1, F.lit(" "))
        .otherwise(F.concat(F.lit(" Page "), _k().cast("string")))
        .alias("title"),
        _k().alias("visit_count"),
        F.when(_k() == 9, F.lit(None).cast("bigint")).when(_k() == 10, F.lit(0)).otherwise(epoch).alias("last_visit"),
        "device",
        "user",
    )


def file_records(spark: SparkSession, folder: str) -> DataFrame:
    e = _source(activity_events(spark, folder), "FileSystem")
    op = (
        F.when(_k() % 9 == 0, "opened")
        .when(F.col("event_type") == "FILE_CREATED", "created")
        .when(F.col("event_type") == "FILE_MODIFIED", "modified")
        .when(F.col("event_type") == "FILE_DELETED", "deleted")
        .otherwise("moved")
    )
    return e.select(
        op.alias("operation"),
        F.col("file_path").alias("src_path"),
        F.when(_k() % 2 == 1, F.concat("file_path", F.lit(".bak"))).alias("dest_path"),
        (_k() % 5 == 0).alias("is_directory"),
        F.col("ts").alias("seen_at"),
        "device",
    )


def usb_records(spark: SparkSession, folder: str) -> DataFrame:
    e = _source(activity_events(spark, folder), "USB")
    k2 = F.lpad(_k().cast("string"), 2, "0")
    bus = F.when(_k() % 6 == 0, "hid").when(_k() % 6 == 1, "usb").otherwise("USB")
    dev = F.concat(
        bus, F.lit("\\VID_0a"), k2, F.lit("&PID_c9"), k2, F.when(_k() % 4 == 0, "").otherwise(F.concat(F.lit("\\5&"), k2))
    )
    return e.select(
        "event_type",
        F.when(_k() % 3 != 0, F.concat(F.lit(" Disk "), k2)).alias("name"),
        F.lit(None).cast("string").alias("device_id"),
        dev.alias("pnp_device_id"),
        F.lit("Maker").alias("manufacturer"),
        F.when(_k() % 2 == 0, F.lit("Mass storage")).alias("description"),
        F.lit("OK").alias("status"),
        F.when(_k() % 8 == 0, F.lit("SER1")).alias("serial_number"),
        F.col("ts").alias("seen_at"),
        "device",
        (_k() % 2 == 0).alias("observed"),
    )


def collector_batches(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from sleuthframe.sources import records as r

    return {
        "windows": r.windows_events(windows_records(spark, folder)),
        "defender": r.defender_events(defender_xml(spark, folder)).where("NOT malformed"),
        "usb": r.usb_events(r.usb_only(usb_records(spark, folder))),
        "browser": r.browser_events(browser_history(spark, folder)),
    }


def stored_chain(spark: SparkSession, folder: str, tampered: bool = False) -> DataFrame:
    """Events with hash columns, chained per id segment; the tampered variant edits, deletes and inserts rows."""
    rows = build_chain(activity_events(spark, folder), segment(QUERY_SEGMENT))
    if not tampered:
        return rows
    gone = (F.col("event_type") == "BROWSER_VISIT") & (_k() == 13)
    bare = (F.col("event_type") == "FILE_DELETED") & (_k() == 42)
    return rows.where(~gone).withColumns(
        {
            "severity": F.when(F.col("severity") == "CRITICAL", "INFO").otherwise(F.col("severity")),
            "event_hash": F.when(~bare, F.col("event_hash")),
            "previous_hash": F.when(~bare, F.col("previous_hash")),
        }
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """A question written about every event, and every document text, as one text column."""
    e = activity_events(spark, folder).withColumn("k", _k())
    hour = F.hour("ts")
    asked = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in (
            "Show the timeline of", "What unusual", "Why were there related", "List high severity", "Verify integrity of",
        )]), F.col("k") % 5 + 1),
        F.lit(" "), F.col("source"), F.lit(" activity: "),
        F.when(F.col("source") == "FileSystem", "files deleted or renamed")
        .when(F.col("source") == "USB", "removable drive connected")
        .when(F.col("source") == "Browser", "websites visited")
        .when(F.col("source") == "Defender", "malware threat, critical")
        .otherwise("windows event logon"),
        F.when(F.col("user") != "", F.concat(F.lit(" by user "), "user")).otherwise(""),
        F.lit(" on host "), F.col("device"),
        F.when(F.col("file_path") != "", F.concat(F.lit(" touching \""), F.col("file_path"), F.lit("\""))).otherwise(""),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit(" between "), hour.cast("string"), F.lit(":00 and 5 pm")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit(" after "), hour.cast("string"), F.lit(":30")))
        .when(F.col("k") % 4 == 2, F.lit(" before 9 a.m."))
        .otherwise(F.lit(" around noon")),
    )
    own = e.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("note_id"), asked.alias("text"))
    docs = read_table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"), text("text").alias("text")
    )
    return own.unionByName(docs)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One investigation request per nation; its region decides the kind of request."""
    n = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("case_id"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("name")
    )
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    r, key = F.col("r"), F.col("case_id")
    return n.select(
        "case_id",
        F.concat(F.lit("What happened in "), "name", F.lit("?")).alias("question"),
        F.lit("timeline").alias("intent"),
        F.when(r == 0, some("USB", "FileSystem", "USB")).when(r == 1, some("Browser")).when(r == 2, some("Defender", "Windows")).otherwise(none).alias("sources"),
        F.when(key == 7, some("FILE_DELETED")).otherwise(none).alias("event_types"),
        F.when(r == 3, F.array(F.concat(F.lit("FILE"), key.cast("string"), F.lit(".docx")))).otherwise(none).alias("keywords"),
        F.when(key == 24, F.lit("nobody")).otherwise(F.lit(None).cast("string")).alias("user"),
        F.when(r == 4, F.concat(F.lit(" HOST-"), (key % 20).cast("string"))).otherwise(F.lit(None).cast("string")).alias("device"),
        F.when(r == 3, F.lit("/DIR")).otherwise(F.lit(None).cast("string")).alias("file_path"),
        F.when(r == 2, F.lit(" critical ")).otherwise(F.lit(None).cast("string")).alias("severity"),
        F.when(r == 1, F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))).otherwise(F.lit(None).cast("timestamp_ntz")).alias("start_time"),
        F.when(r == 1, F.to_timestamp_ntz(F.lit("2024-01-20 12:00:00"))).otherwise(F.lit(None).cast("timestamp_ntz")).alias("end_time"),
        F.when(r == 0, F.lit(8)).when(key == 8, F.lit(25)).otherwise(F.lit(None).cast("int")).alias("hour_start"),
        F.when(r == 0, F.lit(18)).when(key == 8, F.lit(26)).otherwise(F.lit(None).cast("int")).alias("hour_end"),
        F.when(key == 3, 5000).when(key == 11, 0).otherwise(40 + key).cast("int").alias("max_rows"),
        (key % 2 == 0).alias("with_correlation"),
        (key % 3 == 0).alias("with_behavior"),
        (key % 5 < 3).alias("with_integrity"),
    )


def polled_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Log records with channel and number, and cursors of some channels: one behind, one ahead, one missing."""
    w = windows_records(spark, folder).select("channel", F.col("RecordNumber").alias("record_number"), F.col("TimeGenerated").alias("ts"))
    per = w.groupBy("channel").agg(F.max("record_number").alias("hi"))
    cursors = per.where("channel <> 'Channel2'").select(
        "channel",
        F.when(F.col("channel") == "Channel0", F.floor(F.col("hi") / 2)).otherwise(F.col("hi") + 1000).alias("record_number"),
    )
    return w, cursors


def polled_visits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visits rounded to the day, so that many share a time; cursors and boundary of some profiles."""
    from sleuthframe.operators.cursors import profile_key, url_key
    from sleuthframe.sources.records import browser_events

    v = browser_events(browser_history(spark, folder)).select(
        profile_key(F.col("browser"), F.col("profile")).alias("profile_key"),
        F.date_trunc("DAY", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
        F.col("file_path").alias("url"),
    )
    v = v.distinct()
    some = v.where("profile_key <> 'Edge::P1'")
    cursors = some.groupBy("profile_key").agg(F.date_sub(F.max("ts"), 3).cast("timestamp_ntz").alias("last_visit"))
    boundary = (
        v.join(cursors, "profile_key").where("ts = last_visit AND length(url) % 2 = 0").select("profile_key", url_key(F.col("url")).alias("url_key"))
    )
    return v, cursors, boundary
