import datetime as dt
import json

from sleuthframe.sources import records as r

NS = 'xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'
THREAT = f"""<Event {NS}><System><Provider Name="P"/><EventID>1116</EventID><Level>3</Level>
<TimeCreated SystemTime="2026-03-01T10:00:00.1234567Z"/><EventRecordID>42</EventRecordID><Computer>H1</Computer>
<Security UserID="S-1"/></System><EventData><Data Name="Threat Name">Bad</Data><Data Name="Action Name">Block</Data>
<Data Name="Path">C:\\x</Data><Data Name="Severity Name">Severe</Data><Data>loose</Data></EventData></Event>"""
PLAIN = f"<Event {NS}><System><EventID>1000</EventID><Level>2</Level></System></Event>"


def test_antivirus_xml(spark):
    df = spark.createDataFrame([(1, THREAT), (2, PLAIN), (3, "<Event><x")], "id int, xml string")
    got = {x["id"]: x for x in r.defender_events(df).collect()}
    a = got[1]
    assert a["ts"] == dt.datetime(2026, 3, 1, 10, 0, 0, 123456)
    assert a["description"] == "Windows Defender detected threat: Bad (action: Block) [path: C:\\x]"
    assert (a["severity"], a["user"], a["device"], a["file_path"], a["event_type"]) == ("Severe", "S-1", "H1", "C:\\x", "1116")
    meta = json.loads(a["metadata"])
    assert meta["event_data"]["data_4"] == "loose"
    assert meta["threat_name"] == "Bad" and meta["event_id"] == 1116 and meta["record_number"] == "42" and meta["level"] == 3
    assert (got[2]["severity"], got[2]["description"], got[2]["ts"]) == ("ERROR", "Windows Defender event 1000", None)
    assert [got[i]["malformed"] for i in (1, 2, 3)] == [False, False, True]


def test_log_records(spark):
    schema = (
        "channel string, TimeGenerated timestamp_ntz, SourceName string, EventID bigint, EventType int, EventCategory int, "
        "RecordNumber bigint, ComputerName string, Sid string, StringInserts array<string>, Message string"
    )
    t = dt.datetime(2026, 3, 1)
    rows = [("Security", t, "Src", 0xC0001234, 16, None, 7, "H", None, ["a", "", None, "b"], None),
            ("System", t, "", 10, 99, 1, 8, None, "S-1", [], "said")]
    a, b = sorted(r.windows_events(spark.createDataFrame(rows, schema)).collect(), key=lambda x: x["record_number"])
    assert (a["event_type"], a["severity"], a["description"], a["user"]) == (str(0x1234), "AUDIT_FAILURE", "a b", "")
    assert json.loads(a["metadata"]) == {"channel": "Security", "event_id": 0x1234, "event_type_code": 16, "provider": "Src", "record_number": 7}
    assert (b["severity"], b["description"], b["device"], b["user"]) == ("INFO", "said", "", "S-1")


def test_browser_rows(spark):
    schema = "browser string, profile string, family string, url string, title string, visit_count int, last_visit bigint, device string, user string"
    us = 1772359200000000
    rows = [("Chrome", "P", "chromium", " http://a ", None, 1, us + 11644473600000000, "d", "u"),
            ("Firefox", "P", "firefox", "", " ", None, us, None, None), ("Chrome", "P", "chromium", "x", "T", 2, 0, "d", "u")]
    got = r.browser_events(spark.createDataFrame(rows, schema)).collect()
    said = {x["description"]: x for x in got}
    assert set(said) == {"Chrome visited: http://a", "Firefox visited: (no title)", "Chrome visited: T"}
    assert said["Chrome visited: http://a"]["ts"] == said["Firefox visited: (no title)"]["ts"] == dt.datetime(2026, 3, 1, 10)
    assert said["Chrome visited: T"]["ts"] is None
    assert json.loads(said["Firefox visited: (no title)"]["metadata"]) == {"browser": "Firefox", "profile": "P"}


def test_file_and_usb_rows(spark):
    t = dt.datetime(2026, 3, 1)
    schema = "operation string, src_path string, dest_path string, is_directory boolean, seen_at timestamp_ntz, device string"
    rows = [("moved", "/a", "/b", False, t, "d"), ("moved", "/a", None, True, t, "d"), ("opened", "/a", None, False, t, "d")]
    got = {x["description"]: x for x in r.file_events(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v["file_path"] for k, v in got.items()} == {"File renamed from /a to /b": "/b", "Directory renamed from /a to ": "/a"}
    schema = (
        "event_type string, name string, device_id string, pnp_device_id string, manufacturer string, description string, "
        "status string, serial_number string, seen_at timestamp_ntz, device string, observed boolean"
    )
    rows = [("USB_CONNECTED", " Disk ", "USB\\VID_048d&PID_c966\\5&X", None, None, None, "OK", None, t, "d", True),
            ("USB_DISCONNECTED", None, None, "usb\\x", None, None, None, "S9", t, None, False),
            ("USB_CONNECTED", None, None, "HID\\x", None, None, None, None, t, "d", True)]
    df = spark.createDataFrame(rows, schema)
    got = {x["description"]: json.loads(x["metadata"]) for x in r.usb_events(df).collect()}
    one = got["USB device connected: Disk"]
    assert (one["vendor_id"], one["product_id"], one["serial_number"], one["capture"]) == ("048D", "C966", "5&X", "realtime")
    assert got["USB device disconnected: usb\\x"]["serial_number"] == "S9"
    assert r.usb_only(df).count() == 1
