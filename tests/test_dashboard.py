"""The dashboard against plain Python."""

import collections
import datetime as dt
import json

import duckdb
import pytest

import __spark_entry__ as entry_points

SOURCE_OF = {"click": "Browser", "view": "FileSystem", "signup": "Windows", "purchase": "USB", "error": "Defender"}


@pytest.mark.parametrize("n", [0, 4, 30])
def test_summary_has_all_figures(spark, tmp_path, n):
    """Pairs of rows share a time, one row has no time, and some have no user and so no device."""
    start, kinds = dt.datetime(2024, 5, 1, 8), [*SOURCE_OF]
    events = [
        (i, start + dt.timedelta(seconds=i // 2 * 7, microseconds=i // 2) if i != 3 else None, None if i % 6 == 0 else i % 5,
         kinds[i * i % 5], float(i * 9), json.dumps({"k": i, "t": 'a,"b"|\\é'}))
        for i in range(n)
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for row in events:
        con.execute("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", row)
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")

    (got,) = entry_points.queries()["dashboard_summary"](spark, str(tmp_path)).collect()
    assert got["total_events"] == n
    assert got["latest_event_time"] == max((e[1] for e in events if e[1]), default=None)
    by_source = collections.Counter(SOURCE_OF[e[3]] for e in events)
    assert got["by_source"] == "|".join(f"{k}={by_source[k]}" for k in sorted(by_source))

    def severity(kind, k, value):
        if kind == "error":
            return "CRITICAL" if value >= 100 else "HIGH" if value >= 50 else "WARNING"
        return ("AUDIT_FAILURE" if k % 10 == 0 else "AUDIT_SUCCESS") if kind == "signup" else "INFO"

    by_severity = collections.Counter(severity(e[3], e[0], e[4]) for e in events)
    assert got["by_severity"] == "|".join(f"{k}={by_severity[k]}" for k in sorted(by_severity))

    newest = sorted(events, key=lambda e: (e[1] or dt.datetime.min, e[0]), reverse=True)[:10]
    recent = json.loads(got["recent_events"])
    assert [(r["id"], r["ts"], r["source"], r["severity"], r["metadata"]) for r in recent] == [
        (e[0] + 1, e[1] and e[1].isoformat(), SOURCE_OF[e[3]], severity(e[3], e[0], e[4]), e[5]) for e in newest
    ]
    assert [(r["user"], r["device"]) for r in recent] == [
        ("" if e[2] is None or e[3] in ("purchase", "view") else f"user{e[2]}", "" if e[2] is None else f"HOST-{e[2]}") for e in newest
    ]
    keys = ["id", "ts", "source", "event_type", "description", "severity", "user", "device", "file_path", "metadata"]
    assert all([*r] == keys and r["event_type"] and r["description"].startswith(f"{r['source']} {r['event_type']}") for r in recent)


def test_summary_equals_its_sql_on_hard_texts(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-05-01' + to_seconds(i // 3 * 60) AS ts, i % 4 AS user_id,
      ['click', 'view', 'error'][i % 3 + 1] AS event_type, CAST(i AS DOUBLE) AS value, to_json({{'k': i, 't': 'a,"b"|\\é'}})::VARCHAR AS props
      FROM range(40) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    (got,) = entry_points.queries()["dashboard_summary"](spark, str(tmp_path)).collect()
    want = con.execute(entry_points.oracle_sql()["dashboard_summary"])
    assert got.asDict() == dict(zip([c[0] for c in want.description], want.fetchone(), strict=True))
