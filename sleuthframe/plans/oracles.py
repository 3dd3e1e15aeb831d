"""DuckDB SQL for the registered queries, written pair by pair and row by row where Spark takes a shorter way."""

from __future__ import annotations

import re

from sleuthframe.functions import tagging as tag
from sleuthframe.operators import cases as K
from sleuthframe.sources.records import DEFENDER_CHANNEL
from sleuthframe.vocabulary import TEXT_COLUMNS

ORACLES: dict[str, str] = {}
COLS = "id, ts, source, event_type, description, severity, \"user\", device, file_path, metadata"


def events(name: str = "ev", missing: bool = False) -> str:
    device = "'HOST-' || (u % 20)"
    if missing:
        device = f"CASE WHEN k % 25 = 0 THEN '' ELSE {device} END"
    return f"""
{name}_raw AS (SELECT event_id, ts, user_id AS u, event_type AS a, value AS v, props,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
{name}_0 AS (SELECT event_id + 1 AS id, ts, k,
  CASE a WHEN 'click' THEN 'Browser' WHEN 'view' THEN 'FileSystem' WHEN 'signup' THEN 'Windows'
    WHEN 'purchase' THEN 'USB' ELSE 'Defender' END AS source,
  CASE a WHEN 'click' THEN 'BROWSER_VISIT'
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'FILE_CREATED' WHEN 1 THEN 'FILE_MODIFIED' WHEN 2 THEN 'FILE_DELETED'
      ELSE 'FILE_RENAMED' END
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN '4624' ELSE '4625' END
    WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'USB_CONNECTED' ELSE 'USB_DISCONNECTED' END ELSE '1116' END AS event_type,
  CASE a WHEN 'error' THEN CASE WHEN v >= 100 THEN 'CRITICAL' WHEN v >= 50 THEN 'HIGH' ELSE 'WARNING' END
    WHEN 'signup' THEN CASE WHEN k % 10 = 0 THEN 'AUDIT_FAILURE' ELSE 'AUDIT_SUCCESS' END ELSE 'INFO' END AS severity,
  CASE WHEN a IN ('purchase', 'view') THEN '' ELSE 'user' || u END AS "user",
  {device} AS device,
  CASE WHEN a IN ('view', 'error') THEN 'C:/data/dir' || (k % 7) || '/file' || k || '.docx'
    WHEN a = 'click' THEN 'http://example.test/p' || k ELSE '' END AS file_path,
  props AS metadata FROM {name}_raw),
{name} AS (SELECT *, source || ' ' || event_type || CASE WHEN file_path <> '' THEN ' ' || file_path ELSE '' END AS description
  FROM {name}_0)"""


EV = "WITH RECURSIVE " + events()
EVM = "WITH RECURSIVE " + events(missing=True)


def iso(c: str = "ts") -> str:
    return (
        f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', {c}) % 1000000 <> 0 "
        f"THEN strftime({c}, '.%f') ELSE '' END)"
    )


def js(c: str) -> str:
    return f"CAST(to_json({c}) AS VARCHAR)"


def text_json(**fields: str) -> str:
    """JSON object text; a field whose SQL value is null is left out. Values are ready JSON texts."""
    parts = [f"'\"{k}\":' || ({v})" for k, v in sorted(fields.items())]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


HEAD = (
    "'{\"description\":' || " + js("description") + " || ',\"device\":' || " + js("device") + " || ',\"event_type\":' || "
    + js("event_type") + " || ',\"file_path\":' || " + js("file_path") + " || ',\"metadata\":' || " + js("metadata")
    + " || ',\"previous_hash\":\"'"
)
TAIL = (
    "'\",\"severity\":' || " + js("severity") + " || ',\"source\":' || " + js("source") + " || ',\"timestamp\":\"' || "
    + iso() + " || '\",\"user\":' || " + js('"user"') + " || '}'"
)


def category(source: str = "source", kind: str = "event_type") -> str:
    return f"""CASE WHEN {source} = 'USB' OR starts_with(upper({kind}), 'USB_') THEN 'usb'
    WHEN {source} = 'FileSystem' OR starts_with(upper({kind}), 'FILE_') THEN 'file'
    WHEN {source} = 'Browser' OR upper({kind}) = 'BROWSER_VISIT' THEN 'browser'
    WHEN {source} = 'Defender' THEN 'defender' WHEN {source} = 'Windows' THEN 'windows' ELSE 'other' END"""


RANK = "CASE upper(severity) WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 WHEN 'MEDIUM' THEN 1 WHEN 'AUDIT_FAILURE' THEN 1 ELSE 0 END"


# -- reads and counts ----------------------------------------------------------------------------------------

ORACLES["event_scan"] = EV + " SELECT id, ts, source, event_type, description, metadata FROM ev"
ORACLES["event_by_id"] = EV + f" SELECT {COLS} FROM ev WHERE id = 500"
ORACLES["events_page"] = EV + f""" SELECT {COLS} FROM ev WHERE source = 'Windows' AND severity = 'AUDIT_SUCCESS'
  AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25 12:00:00' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 20"""
ORACLES["timeline_page"] = EV + f" SELECT {COLS} FROM ev WHERE device = 'HOST-3' ORDER BY ts, id LIMIT 200 OFFSET 100"
ORACLES["events_page_total"] = EV + f""" SELECT {COLS}, (SELECT count(*) FROM ev WHERE source = 'USB' AND device = 'HOST-5') AS total FROM ev
  WHERE source = 'USB' AND device = 'HOST-5' ORDER BY ts, id LIMIT 30 OFFSET 10"""
ORACLES["events_after"] = EV + f""" SELECT {COLS} FROM ev WHERE severity = 'INFO' AND (ts, id) > (TIMESTAMP '2024-01-09 12:00:00', 1000000) ORDER BY ts, id LIMIT 60"""
ORACLES["recent_events"] = EV + f" SELECT {COLS} FROM ev ORDER BY ts DESC, id DESC LIMIT 10"


def limited(where: str, cols: str, limit: int) -> str:
    return EV + f""", hit AS (SELECT * FROM ev WHERE {where} ORDER BY ts, id LIMIT {limit})
  SELECT {cols}, (SELECT count(*) FROM hit) >= {limit} AS truncated FROM hit"""


ORACLES["retrieve_filters"] = limited(
    "source IN ('FileSystem', 'Defender') AND event_type IN ('FILE_CREATED', 'FILE_DELETED', '1116') AND file_path ILIKE '%dir3/%'",
    "id, ts, source, event_type, file_path", 150,
)
_any = "(description ILIKE '%{0}%' OR file_path ILIKE '%{0}%' OR metadata ILIKE '%{0}%')"
ORACLES["retrieve_keywords"] = limited(
    " AND ".join(_any.format(w) for w in ("file1", ".docx", "1")), "id, description", 1000
)
ORACLES["retrieve_hours"] = limited("hour(ts) BETWEEN 22 AND 23 AND \"user\" = 'user7'", "id, ts", 500)
ORACLES["related_events"] = EV + """, top AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS n FROM ev)
  SELECT e.id, e.source, coalesce(string_agg(CAST(t.id AS VARCHAR), '|' ORDER BY t.n) FILTER (WHERE t.id <> e.id), '') AS related_ids
  FROM ev e JOIN top t ON t.source = e.source AND t.n <= 15 GROUP BY e.id, e.source"""
ORACLES["ingest_roundtrip"] = EV + """ SELECT strftime(ts, '%Y-%m-%d') AS event_date, source, count(*) AS n, min(id) AS lo, max(id) AS hi
  FROM ev GROUP BY 1, 2"""
ORACLES["legacy_union"] = EV + """, u AS (SELECT source, 1 AS h FROM ev UNION ALL SELECT source, NULL FROM ev WHERE source = 'USB')
  SELECT source, count(*) AS n, count(h) AS hashed FROM u GROUP BY 1"""
ORACLES["legacy_union_all"] = EV + """, u AS (SELECT source, 1 AS h FROM ev UNION ALL SELECT source, NULL FROM ev)
  SELECT source, count(*) AS n, count(h) AS hashed FROM u GROUP BY 1"""
ORACLES["count_events"] = EV + " SELECT count(*) AS n FROM ev WHERE source = 'Defender' AND severity = 'HIGH' AND ts >= TIMESTAMP '2024-01-02'"
for _c in ("source", "severity", "event_type", "user", "device"):
    _name = "type" if _c == "event_type" else _c
    ORACLES[f"count_by_{_name}"] = EVM + f' SELECT coalesce("{_c}", \'\') AS value, count(*) AS n FROM ev GROUP BY 1'
ORACLES["source_stats"] = EV + " SELECT source, count(*) AS events, max(ts) AS last_event_time FROM ev GROUP BY 1"
ORACLES["severity_breakdown"] = EV + """ SELECT severity, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
  count(*) / sum(count(*)) OVER () AS share,
  CASE severity WHEN 'CRITICAL' THEN 7 WHEN 'HIGH' THEN 6 WHEN 'ERROR' THEN 5 WHEN 'MEDIUM' THEN 4 WHEN 'WARNING' THEN 3
    WHEN 'AUDIT_FAILURE' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 WHEN 'AUDIT_SUCCESS' THEN 1 ELSE 0 END AS weight
  FROM ev GROUP BY severity"""
ORACLES["top_sources"] = EV + " SELECT source AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, value LIMIT 10"
ORACLES["activity_buckets"] = EV + """, t AS (SELECT epoch_us(ts) // 1000 AS t FROM ev),
  s AS (SELECT min(t) AS lo, least(24, greatest(6, count(*))) AS k, greatest(max(t) - min(t), 1) AS span FROM t),
  b AS (SELECT CAST(least(k - 1, floor((t - lo) / (span / k))) AS INT) AS slot, count(*) AS n FROM t, s GROUP BY 1)
  SELECT CAST(g.i AS INT) AS slot, make_timestamp(CAST(floor((lo + g.i * (span / k)) * 1000) AS BIGINT)) AS slot_start,
    coalesce(b.n, 0) AS n FROM s, range(24) AS g(i) LEFT JOIN b ON b.slot = g.i WHERE g.i < k"""
ORACLES["collector_attribution"] = EV + """, c AS (SELECT CASE WHEN severity = 'HIGH' THEN 'Scanner' WHEN severity = 'AUDIT_FAILURE'
    THEN 'Security System' ELSE source END AS s, count(*) AS n FROM ev GROUP BY 1),
  w(collector, word) AS (VALUES ('windows', 'windows'), ('windows', 'event'), ('windows', 'eventlog'), ('windows', 'security'),
    ('windows', 'system'), ('defender', 'defender'), ('defender', 'antivirus'), ('defender', 'threat'), ('file', 'file'),
    ('file', 'filesystem'), ('file', 'ntfs'), ('usb', 'usb'), ('usb', 'removable'), ('browser', 'browser'), ('browser', 'chrome'),
    ('browser', 'edge'), ('browser', 'firefox')),
  hit AS (SELECT DISTINCT collector, s, n FROM c JOIN w ON contains(lower(s), word))
  SELECT d.collector, '' AS source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT collector FROM w) d LEFT JOIN hit USING (collector) GROUP BY 1
  UNION ALL SELECT 'other', s, n FROM c WHERE s NOT IN (SELECT s FROM hit)"""

# -- collectors ----------------------------------------------------------------------------------------------

ORACLES["src_windows"] = EV + """, w AS (SELECT *, 'Channel' || (id % 3) AS channel,
    CASE WHEN severity = 'AUDIT_FAILURE' THEN 16 WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 3 ELSE 8 END AS code FROM ev WHERE source = 'Windows')
  SELECT channel, id AS record_number, source, event_type, ts,
    CASE WHEN k % 2 = 0 THEN description ELSE "user" || ' ' || device END AS description,
    CASE code WHEN 16 THEN 'AUDIT_FAILURE' WHEN 2 THEN 'WARNING' WHEN 8 THEN 'AUDIT_SUCCESS' ELSE 'INFO' END AS severity,
    CASE WHEN k % 3 <> 0 THEN 'S-1-5-' || "user" ELSE '' END AS "user", device, '' AS file_path,
    """ + text_json(
    channel=js("channel"), event_category="CASE WHEN k % 4 <> 0 THEN CAST(k % 4 AS VARCHAR) END", event_id="event_type",
    event_type_code="CAST(code AS VARCHAR)", provider="'\"Auditing\"'", record_number="CAST(id AS VARCHAR)",
) + " AS metadata FROM w"
_data = text_json(
    **{
        "Action Name": "CASE WHEN k % 3 = 0 THEN '\"Quarantine\"' END",
        "Path": js("file_path"),
        "Severity Name": "CASE WHEN k % 2 = 0 THEN '\"Severe\"' END",
        "Threat Name": "'\"Threat.K' || k || '\"'",
        "data_x": "'\"extra\"'",
    }
).replace('"data_x"', '"data_\' || (2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) || \'"')
ORACLES["src_defender"] = EV + f""", x AS (SELECT *, k = 17 AS malformed, k % 11 <> 0 AND k <> 17 AS d, k <> 17 AS o, k % 6 AS lvl FROM ev WHERE source = 'Defender')
  SELECT id, malformed, CASE WHEN o THEN CAST(id AS VARCHAR) END AS record_number, source, CASE WHEN o THEN event_type END AS event_type,
    CASE WHEN o THEN ts END AS ts,
    CASE WHEN d THEN 'Windows Defender detected threat: Threat.K' || k || CASE WHEN k % 3 = 0 THEN ' (action: Quarantine)' ELSE '' END
      || ' [path: ' || file_path || ']' ELSE 'Windows Defender event ' || CASE WHEN o THEN event_type ELSE 'None' END END AS description,
    CASE WHEN d AND k % 2 = 0 THEN 'Severe' WHEN NOT o THEN 'INFO' ELSE CASE lvl WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'WARNING'
      WHEN 5 THEN 'VERBOSE' ELSE 'INFO' END END AS severity,
    CASE WHEN o THEN "user" ELSE '' END AS "user", CASE WHEN o THEN device ELSE '' END AS device,
    CASE WHEN d THEN file_path ELSE '' END AS file_path,
    {text_json(
        action_name="CASE WHEN d AND k % 3 = 0 THEN '\"Quarantine\"' END", channel=f"'\"{DEFENDER_CHANNEL}\"'",
        event_data=f"CASE WHEN d THEN {_data} ELSE '{{}}' END", event_id="CASE WHEN o THEN event_type END",
        level="CASE WHEN o THEN CAST(lvl AS VARCHAR) END", path="CASE WHEN d THEN " + js("file_path") + " END",
        provider="CASE WHEN o THEN '\"Guard\"' END", record_number="CASE WHEN o THEN '\"' || id || '\"' END",
        severity_name="CASE WHEN d AND k % 2 = 0 THEN '\"Severe\"' END", threat_name="CASE WHEN d THEN '\"Threat.K' || k || '\"' END",
    )} AS metadata FROM x"""  # fmt: skip
_history = """, h AS (SELECT CASE id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Edge' ELSE 'Firefox' END AS browser, 'P' || (k % 4) AS profile, k,
    file_path AS url, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' Page ' || k END AS title, device, "user", id, ts AS t FROM ev WHERE source = 'Browser'),
  hist AS (SELECT *, CASE WHEN k = 9 THEN NULL WHEN k = 10 THEN 0 WHEN browser = 'Firefox' THEN epoch_us(t)
    ELSE epoch_us(t) + 11644473600000000 END AS last_visit, CASE WHEN k NOT IN (9, 10) THEN t END AS ts FROM h)"""
ORACLES["src_browser"] = EV + _history + """ SELECT browser, profile, 'Browser' AS source, 'BROWSER_VISIT' AS event_type, ts,
    browser || ' visited: ' || CASE WHEN k % 3 = 2 THEN 'Page ' || k ELSE url END AS description, 'INFO' AS severity, "user", device,
    url AS file_path, """ + text_json(
    browser=js("browser"), profile=js("profile"), url=js("url"), title="CASE WHEN k % 3 = 2 THEN '\"Page ' || k || '\"' END",
    visit_count="CAST(k AS VARCHAR)",
) + " AS metadata FROM hist"
ORACLES["src_browser_topn"] = EV + _history + """, r AS (SELECT browser, profile, url, last_visit,
    row_number() OVER (PARTITION BY browser, profile ORDER BY last_visit DESC NULLS LAST, url) AS n
    FROM hist WHERE browser <> 'Firefox' OR last_visit IS NOT NULL) SELECT browser, profile, url, last_visit FROM r WHERE n <= 5"""
ORACLES["src_file"] = EV + """, f AS (SELECT *, CASE WHEN k % 2 = 1 THEN file_path || '.bak' ELSE '' END AS dest,
    CASE WHEN k % 5 = 0 THEN 'Directory' ELSE 'File' END AS noun FROM ev WHERE source = 'FileSystem' AND k % 9 <> 0)
  SELECT source, event_type, ts, CASE WHEN event_type = 'FILE_RENAMED' THEN noun || ' renamed from ' || file_path || ' to ' || dest
      ELSE noun || ' ' || lower(substr(event_type, 6)) || ': ' || file_path END AS description, 'INFO' AS severity, '' AS "user", device,
    CASE WHEN event_type = 'FILE_RENAMED' AND dest <> '' THEN dest ELSE file_path END AS file_path,
    """ + text_json(
    is_directory="CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END", src_path=js("file_path"),
    old_path="CASE WHEN event_type = 'FILE_RENAMED' THEN " + js("file_path") + " END",
    new_path="CASE WHEN event_type = 'FILE_RENAMED' THEN " + js("dest") + " END",
) + " AS metadata FROM f"
_usb = """, u AS (SELECT *, lpad(CAST(k AS VARCHAR), 2, '0') AS kk, CASE k % 6 WHEN 0 THEN 'hid' WHEN 1 THEN 'usb' ELSE 'USB' END
    || '\\VID_0a' || lpad(CAST(k AS VARCHAR), 2, '0') || '&PID_c9' || lpad(CAST(k AS VARCHAR), 2, '0')
    || CASE WHEN k % 4 = 0 THEN '' ELSE '\\5&' || lpad(CAST(k AS VARCHAR), 2, '0') END AS dev FROM ev WHERE source = 'USB' AND k % 6 <> 0)"""
ORACLES["src_usb"] = EV + _usb + """ SELECT source, event_type, ts, 'USB device ' || CASE WHEN event_type = 'USB_CONNECTED' THEN 'connected' ELSE 'disconnected' END
    || ': ' || CASE WHEN k % 3 <> 0 THEN 'Disk ' || kk WHEN k % 2 = 0 THEN 'Mass storage' ELSE dev END AS description,
    'INFO' AS severity, '' AS "user", device, '' AS file_path, """ + text_json(
    capture="CASE WHEN k % 2 = 0 THEN '\"realtime\"' ELSE '\"current_state\"' END",
    description="CASE WHEN k % 2 = 0 THEN '\"Mass storage\"' END", device_id=js("dev"),
    device_name="CASE WHEN k % 3 <> 0 THEN '\"Disk ' || kk || '\"' END", manufacturer="'\"Maker\"'", pnp_device_id=js("dev"),
    product_id="'\"C9' || kk || '\"'",
    serial_number="CASE WHEN k % 8 = 0 THEN '\"SER1\"' WHEN k % 4 <> 0 THEN '\"5&' || kk || '\"' END",
    status="'\"OK\"'", vendor_id="'\"0A' || kk || '\"'",
) + " AS metadata FROM u"
ORACLES["src_since_topn"] = EV + """, r AS (SELECT 'Channel' || (id % 3) AS channel, id AS record_number, ts,
    row_number() OVER (PARTITION BY id % 3 ORDER BY ts DESC, id DESC) AS n FROM ev WHERE source = 'Windows' AND ts >= TIMESTAMP '2024-01-10')
  SELECT channel, record_number, ts FROM r WHERE n <= 7"""
ORACLES["ingest_union"] = EV + _usb + """, un AS (
  SELECT source, event_type, CASE WHEN severity = 'AUDIT_FAILURE' THEN 'AUDIT_FAILURE' WHEN k % 7 = 0 THEN 'WARNING' WHEN k % 5 = 0 THEN 'INFO'
    ELSE 'AUDIT_SUCCESS' END AS severity, ts FROM ev WHERE source = 'Windows'
  UNION ALL SELECT source, event_type, CASE WHEN k % 11 <> 0 AND k % 2 = 0 THEN 'Severe' ELSE CASE k % 6 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'ERROR'
    WHEN 3 THEN 'WARNING' WHEN 5 THEN 'VERBOSE' ELSE 'INFO' END END, ts FROM ev WHERE source = 'Defender' AND k <> 17
  UNION ALL SELECT source, event_type, 'INFO', ts FROM u
  UNION ALL SELECT source, event_type, 'INFO', CASE WHEN k NOT IN (9, 10) THEN ts END FROM ev WHERE source = 'Browser')
  SELECT source, event_type, severity, count(*) AS n, max(ts) AS last FROM un GROUP BY 1, 2, 3"""

# -- normalization -------------------------------------------------------------------------------------------

_normal = """, n0 AS (SELECT *, CASE
    WHEN source <> 'Windows' AND k = 11 THEN 'source is required'
    WHEN source = 'FileSystem' AND k = 7 THEN 'timestamp is missing'
    WHEN source = 'Defender' AND k = 3 THEN 'timestamp is not recognized'
    WHEN source = 'Browser' AND k = 5 THEN 'description is required but empty' END AS reason,
    CASE WHEN source IN ('Browser', 'FileSystem', 'USB') THEN date_trunc('second', ts) ELSE ts END AS t FROM ev)"""
ORACLES["normalize"] = EV + _normal + """ SELECT id AS batch_pos, t AS ts, source, event_type, description,
    CASE WHEN source = 'USB' THEN 'INFO' ELSE severity END AS severity, "user", device, file_path,
    CASE WHEN source = 'Defender' THEN '{"by":"agent","k":' || k || ',"zone":' || (k % 5) || '}' ELSE '{"k":' || k || '}' END AS metadata
  FROM n0 WHERE reason IS NULL"""
ORACLES["normalize_rejects"] = EV + _normal + """ SELECT id AS batch_pos,
    CASE WHEN reason LIKE 'description%' THEN 'validation' ELSE 'normalize' END AS stage, reason FROM n0 WHERE reason IS NOT NULL"""
ORACLES["ingest_stats"] = EV + _normal + """ SELECT 2 * count(*) AS received,
    2 * count(*) FILTER (WHERE reason IS NULL OR reason LIKE 'description%') AS normalized,
    count(DISTINCT (t, source, event_type, description, "user", device, file_path, k)) FILTER (WHERE reason IS NULL) AS inserted,
    2 * count(*) FILTER (WHERE reason LIKE 'description%') AS skipped,
    2 * count(*) FILTER (WHERE reason IS NULL) - count(DISTINCT (t, source, event_type, description, "user", device, file_path, k))
      FILTER (WHERE reason IS NULL) AS duplicates,
    2 * count(*) FILTER (WHERE reason NOT LIKE 'description%') AS errors FROM n0"""
ORACLES["ingest_order"] = EV + _normal + """ SELECT 100 + row_number() OVER (ORDER BY t, id) AS id, t AS ts, source FROM n0 WHERE reason IS NULL"""
ORACLES["dedup_events"] = EV + """, d AS (SELECT id AS batch_pos, date_trunc('day', ts) AS ts, source, event_type, severity, description, file_path FROM ev),
  r AS (SELECT *, row_number() OVER (PARTITION BY ts, source, event_type, description, file_path ORDER BY batch_pos) AS n FROM d)
  SELECT batch_pos, ts, source, event_type, severity, file_path FROM r WHERE n = 1"""
ORACLES["coerce_ts"] = EV + """ SELECT id, CASE k % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts)
    WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 4 THEN date_trunc('day', ts) END AS ts FROM ev"""
ORACLES["categorize"] = EV + f""", s AS (SELECT CASE WHEN severity = 'INFO' THEN 'Agent' ELSE source END AS source, event_type FROM ev)
  SELECT source, event_type, {category()} AS category, count(*) AS n FROM s GROUP BY 1, 2, 3"""
ORACLES["path_features"] = EV + """, p AS (SELECT id, lower(rtrim(replace(replace(file_path, '/', '\\') || '//', '\\', '/'), '/')) AS norm_path FROM ev)
  SELECT id, norm_path, regexp_extract(norm_path, '^(.*)/', 1) AS parent_dir FROM p"""

# -- text ----------------------------------------------------------------------------------------------------

NOTES = """, notes AS (SELECT 'e' || id AS note_id, (CASE k % 5 WHEN 0 THEN 'Show the timeline of' WHEN 1 THEN 'What unusual'
    WHEN 2 THEN 'Why were there related' WHEN 3 THEN 'List high severity' ELSE 'Verify integrity of' END) || ' ' || source || ' activity: '
    || (CASE source WHEN 'FileSystem' THEN 'files deleted or renamed' WHEN 'USB' THEN 'removable drive connected' WHEN 'Browser' THEN 'websites visited'
      WHEN 'Defender' THEN 'malware threat, critical' ELSE 'windows event logon' END)
    || (CASE WHEN "user" <> '' THEN ' by user ' || "user" ELSE '' END) || ' on host ' || device
    || (CASE WHEN file_path <> '' THEN ' touching "' || file_path || '"' ELSE '' END)
    || (CASE k % 4 WHEN 0 THEN ' between ' || hour(ts) || ':00 and 5 pm' WHEN 1 THEN ' after ' || hour(ts) || ':30' WHEN 2 THEN ' before 9 a.m.'
      ELSE ' around noon' END) AS text FROM ev
  UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents)"""
WORD = r"[^\pL\pN_]"


def _edges(p: str) -> str:
    """RE2 has ASCII word borders only: spell them out as 'no letter, digit or underscore'."""
    out, i = "", 0
    for m in re.finditer(r"\\b", p):
        before = p[: m.start()]
        opening = before == "" or before.endswith("|")
        out += p[i : m.start()] + (f"(?:^|{WORD})" if opening else f"(?:$|{WORD})")
        i = m.end()
    return (out + p[i:]).replace("'", "''")


def _hit(p: str, t: str = "lower(text)") -> str:
    return f"regexp_matches({t}, '{_edges(p)}')"


def _labels(rules) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_hit(p)} THEN '{x}' END" for p, x in rules) + ")"


_sev = "CASE " + " ".join(f"WHEN {_hit(p)} THEN '{x}'" for p, x in tag.SEVERITY_RULES) + " END"
_flag = {n: _hit(getattr(tag, f"{n}_WORDS")) for n in ("TIMELINE", "CORRELATION", "BEHAVIOR", "EXPLAIN", "INTEGRITY")}
_intent = f"CASE WHEN {_flag['EXPLAIN']} THEN 'explain' WHEN {_flag['BEHAVIOR']} THEN 'behavior' WHEN {_flag['CORRELATION']} THEN 'correlation' WHEN {_flag['TIMELINE']} THEN 'timeline' ELSE 'search' END"
ORACLES["tag_text"] = EV + NOTES + f""" SELECT note_id, {_labels(tag.SOURCE_RULES)} AS sources, {_labels(tag.EVENT_TYPE_RULES)} AS event_types,
  {_sev} AS severity, {_intent} AS intent, {_flag['CORRELATION']} OR {_flag['EXPLAIN']} AS with_correlation,
  {_flag['BEHAVIOR']} OR {_flag['EXPLAIN']} AS with_behavior, {_flag['INTEGRITY']} AS with_integrity FROM notes"""


def _q(p: str) -> str:
    return p.replace("'", "''")


_user = _q(tag.USER).replace(r"\b", f"(?:^|{WORD})")
_device = _q(tag.DEVICE).replace(r"\b", f"(?:^|{WORD})")
ORACLES["extract_tokens"] = EV + NOTES + f""", x AS (SELECT note_id, text, list_concat(regexp_extract_all(text, '{_q(tag.FILENAME)}'),
    list_transform(regexp_extract_all(text, '{_q(tag.QUOTED)}', 1), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) AS w FROM notes)
  SELECT note_id, nullif(regexp_extract(text, '{_q(tag.PATH)}'), '') AS file_path,
    array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND x <> ''), '|') AS keywords,
    nullif(regexp_extract(text, '{_user}', 1), '') AS "user", nullif(regexp_extract(text, '{_device}', 1), '') AS device FROM x"""


def _clock(t: str) -> str:
    p = tag.CLOCK.replace(r"\b", f"(?:^|{WORD})", 1).replace(r"\b", f"(?:$|{WORD})")
    return f"""(SELECT CASE WHEN v <= 23 THEN v END FROM (SELECT CASE WHEN m = 'pm' AND h < 12 THEN h + 12 WHEN m = 'am' AND h = 12 THEN 0 ELSE h END AS v
      FROM (SELECT TRY_CAST(regexp_extract(s, '{p}', 1) AS INT) AS h, replace(regexp_extract(s, '{p}', 3), '.', '') AS m FROM (SELECT {t} AS s))))"""


_HOURS = NOTES + f""", low AS (SELECT note_id, lower(text) AS l FROM notes),
  part AS (SELECT note_id, regexp_extract(l, '(?:^|{WORD})between\\s+(.+?)\\s+and\\s+(.+)', 1) AS b1,
    regexp_extract(l, '(?:^|{WORD})between\\s+(.+?)\\s+and\\s+(.+)', 2) AS b2, regexp_extract(l, '(?:^|{WORD})after\\s+(.+)', 1) AS af,
    regexp_extract(l, '(?:^|{WORD})before\\s+(.+)', 1) AS bf, regexp_extract(l, '(?:^|{WORD})(?:around|about|near|at)\\s+(.+)', 1) AS ar FROM low),
  hrs AS (SELECT note_id, {_clock('b1')} AS h1, {_clock('b2')} AS h2, {_clock('af')} AS ha, {_clock('bf')} AS hb, {_clock('ar')} AS hr FROM part),
  win AS (SELECT note_id, CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN least(h1, h2) WHEN ha IS NOT NULL THEN ha WHEN hb IS NOT NULL THEN 0 ELSE hr END AS hour_start,
    CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN greatest(h1, h2) WHEN ha IS NOT NULL THEN 23 WHEN hb IS NOT NULL THEN hb ELSE hr END AS hour_end FROM hrs)"""
ORACLES["extract_hours"] = EV + _HOURS + " SELECT note_id, coalesce(hour_start, -1) AS hour_start, coalesce(hour_end, -1) AS hour_end FROM win"
ORACLES["question_requests"] = EV + _HOURS + f""", tg AS (SELECT note_id, {_sev} AS severity, {_intent} AS intent FROM notes)
  SELECT intent, severity, coalesce(hour_start, -1) AS hour_start, coalesce(hour_end, -1) AS hour_end, count(*) AS n FROM tg JOIN win USING (note_id) GROUP BY 1, 2, 3, 4"""

# All notes as requests for the oldest three events. Requests that name a host meet events on it, the others are tested on all.
ORACLES["note_retrieval"] = EV + _HOURS + f""", x AS (SELECT note_id, text, list_concat(regexp_extract_all(text, '{_q(tag.FILENAME)}'),
    list_transform(regexp_extract_all(text, '{_q(tag.QUOTED)}', 1), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) AS w,
    nullif(regexp_extract(text, '{_q(tag.PATH)}'), '') AS path, nullif(regexp_extract(text, '{_user}', 1), '') AS usr, nullif(regexp_extract(text, '{_device}', 1), '') AS dev,
    string_split({_labels(tag.SOURCE_RULES)}, '|') AS srcs, string_split({_labels(tag.EVENT_TYPE_RULES)}, '|') AS types, {_sev} AS sev FROM notes),
  q AS (SELECT note_id, list_filter(list_transform(w, lambda v: lower(v)), lambda v: v <> '') AS words, lower(path) AS path, usr, dev, sev, list_filter(srcs, lambda v: v <> '') AS srcs,
    list_filter(types, lambda v: v <> '') AS types, hour_start AS h1, hour_end AS h2 FROM x JOIN win USING (note_id)),
  cls AS (SELECT list(note_id) AS notes, * EXCLUDE (note_id) FROM q GROUP BY ALL),
  e AS (SELECT id, ts, hour(ts) AS h, source, event_type, severity, "user", device, lower(file_path) AS fp, lower(description) AS ds, lower(metadata) AS md FROM ev),
  hit AS (SELECT cls.notes, cls.words, e.* FROM cls JOIN e ON e.device = cls.dev AND (usr IS NULL OR "user" = usr) AND (sev IS NULL OR severity = sev) AND (h1 IS NULL OR h BETWEEN h1 AND h2)
      AND (len(srcs) = 0 OR list_contains(srcs, source)) AND (len(types) = 0 OR list_contains(types, event_type)) AND (path IS NULL OR contains(fp, path))
    UNION ALL SELECT cls.notes, cls.words, e.* FROM cls JOIN e ON cls.dev IS NULL AND (usr IS NULL OR "user" = usr) AND (sev IS NULL OR severity = sev) AND (h1 IS NULL OR h BETWEEN h1 AND h2)
      AND (len(srcs) = 0 OR list_contains(srcs, source)) AND (len(types) = 0 OR list_contains(types, event_type)) AND (path IS NULL OR contains(fp, path))),
  good AS (SELECT * FROM hit WHERE len(list_filter(words, lambda v: NOT (contains(ds, v) OR contains(fp, v) OR contains(md, v)))) = 0),
  top AS (SELECT notes, id, row_number() OVER (PARTITION BY notes ORDER BY ts, id) AS row_no FROM good QUALIFY row_no <= 3)
  SELECT unnest(notes) AS case_id, row_no, id FROM top"""

# -- requests ------------------------------------------------------------------------------------------------

REQ = """, req0 AS (SELECT n_nationkey AS case_id, n_regionkey AS r, 'What happened in ' || n_name || '?' AS question FROM nation),
  req1 AS (SELECT *, CASE WHEN r = 0 THEN 8 WHEN case_id = 8 THEN 25 END AS h1, CASE WHEN r = 0 THEN 18 WHEN case_id = 8 THEN 26 END AS h2,
    CASE case_id WHEN 3 THEN 5000 WHEN 11 THEN 0 ELSE 40 + case_id END AS lim,
    CASE WHEN r = 4 THEN 'HOST-' || (case_id % 20) END AS dev FROM req0),
  req AS (SELECT *, CASE WHEN h1 > 23 OR h2 > 23 THEN 'hours must be between 0 and 23' WHEN lim <= 0 THEN 'limit must be a positive integer' END AS error,
    CAST(NULL AS VARCHAR) AS warning, lim AS max_rows,
    case_id % 2 = 0 AS with_correlation, case_id % 3 = 0 AS with_behavior, case_id % 5 < 3 AS with_integrity FROM req1)"""
ORACLES["validate_request_rows"] = EV + REQ + """ SELECT case_id, error, warning, CASE WHEN r = 2 THEN 'CRITICAL' END AS severity, max_rows, dev AS device,
  CASE r WHEN 0 THEN 'USB|FileSystem' WHEN 1 THEN 'Browser' WHEN 2 THEN 'Defender|Windows' ELSE '' END AS sources,
  CASE WHEN r = 3 THEN 'FILE' || case_id || '.docx' ELSE '' END AS keywords FROM req"""


def hits(table: str) -> str:
    return f""", hit0 AS (SELECT q.*, e.* EXCLUDE (k), row_number() OVER (PARTITION BY case_id ORDER BY ts, id) AS row_no FROM req q JOIN {table} e ON
      (r <> 0 OR source IN ('USB', 'FileSystem')) AND (r <> 1 OR source = 'Browser') AND (r <> 2 OR source IN ('Defender', 'Windows'))
      AND (case_id <> 7 OR event_type = 'FILE_DELETED') AND (case_id <> 24 OR "user" = 'nobody')
      AND (r <> 2 OR severity = 'CRITICAL') AND (dev IS NULL OR device = dev)
      AND (r <> 1 OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00')
      AND (h1 IS NULL OR hour(ts) BETWEEN h1 AND h2)
      AND (r <> 3 OR (file_path ILIKE '%/dir%' AND (description ILIKE '%file' || case_id || '.docx%' OR file_path ILIKE '%file' || case_id || '.docx%'
        OR metadata ILIKE '%file' || case_id || '.docx%')))
    WHERE error IS NULL),
  hit AS (SELECT * FROM hit0 WHERE row_no <= max_rows)"""


ORACLES["batch_retrieve_rows"] = EV + REQ + hits("ev") + " SELECT case_id, row_no, id, ts FROM hit"

# -- chain ---------------------------------------------------------------------------------------------------

CHAIN = f""", seq AS (SELECT *, (id - 1) // 256 AS chain, {HEAD} AS head, {TAIL} AS tail,
    row_number() OVER (PARTITION BY (id - 1) // 256 ORDER BY id) AS rn FROM ev),
  fold AS (SELECT chain, rn, id, sha256(head || tail) AS event_hash, '' AS previous_hash FROM seq WHERE rn = 1
    UNION ALL SELECT s.chain, s.rn, s.id, sha256(s.head || f.event_hash || s.tail), f.event_hash FROM fold f JOIN seq s ON s.chain = f.chain AND s.rn = f.rn + 1)"""
STORED = CHAIN + """, st0 AS (SELECT e.* EXCLUDE (severity), f.chain, f.event_hash AS h, f.previous_hash AS p,
    CASE WHEN e.severity = 'CRITICAL' THEN 'INFO' ELSE e.severity END AS severity,
    event_type = 'FILE_DELETED' AND k = 42 AS bare FROM ev e JOIN fold f USING (id) WHERE NOT (event_type = 'BROWSER_VISIT' AND k = 13)),
  st AS (SELECT *, CASE WHEN NOT bare THEN h END AS event_hash, CASE WHEN NOT bare THEN p END AS previous_hash FROM st0)"""
VERDICT = STORED + f""", again AS (SELECT *, sha256({HEAD} || coalesce(previous_hash, '') || {TAIL}) AS redo,
    last_value(event_hash IGNORE NULLS) OVER (PARTITION BY chain ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st),
  verdict AS (SELECT chain, id, CASE WHEN event_hash IS NOT NULL THEN 'hashed' WHEN prev IS NOT NULL THEN 'unhashed' ELSE 'legacy' END AS state,
    concat_ws('|', CASE WHEN event_hash IS NULL AND prev IS NOT NULL THEN 'unhashed event after chain start (possible inserted/removed record)' END,
      CASE WHEN event_hash <> redo THEN 'event_hash does not match canonical data' END,
      CASE WHEN event_hash IS NOT NULL AND previous_hash <> coalesce(prev, '') THEN 'previous_hash does not match preceding chained event (chain broken)' END) AS reasons FROM again)"""
ORACLES["row_hash"] = EV + f" SELECT id, sha256({HEAD} || sha256(CAST(id AS VARCHAR)) || {TAIL}) AS recomputed_hash FROM ev"
_built = "SELECT CAST(chain AS VARCHAR) AS chain, id, event_hash, previous_hash FROM fold"
ORACLES["build_chain"] = EV + CHAIN + f" {_built}"
# Ids follow time in this table, so two batches in time order give the same chains as one.
ORACLES["build_chain_batches"] = EV + CHAIN + f" {_built}"
_tips = "tips AS (SELECT chain, max_by(event_hash, id) AS tip, max(id) AS tip_id, count(*) AS n FROM fold GROUP BY 1)"
ORACLES["chain_tip"] = EV + CHAIN + f", {_tips} SELECT CAST(chain AS VARCHAR) AS chain, tip, tip_id, n FROM tips"
ORACLES["chain_seal"] = EV + CHAIN + f""", {_tips},
  seal AS (SELECT CAST(0 AS BIGINT) AS segment, sha256('{{"previous_hash":"","tip":"' || tip || '","tip_id":' || tip_id || '}}') AS seal_hash, '' AS previous_seal FROM tips WHERE chain = 0
    UNION ALL SELECT t.chain, sha256('{{"previous_hash":"' || s.seal_hash || '","tip":"' || tip || '","tip_id":' || tip_id || '}}'), s.seal_hash FROM seal s JOIN tips t ON t.chain = s.segment + 1)
  SELECT * FROM seal"""
ORACLES["chain_verdicts"] = EV + VERDICT + " SELECT CAST(chain AS VARCHAR) AS chain, id, state, reasons FROM verdict"
_verify = """SELECT count(*) FILTER (WHERE reasons <> '') = 0 AS valid, count(*) AS checked_events, count(*) FILTER (WHERE state = 'hashed') AS hashed_events,
  count(*) FILTER (WHERE state = 'legacy') AS legacy_events, count(*) FILTER (WHERE reasons <> '') AS invalid_events,
  CASE WHEN count(*) = 0 THEN 'NO_EVENTS' WHEN count(*) FILTER (WHERE reasons <> '') = 0 THEN 'VALID' ELSE 'INVALID' END AS status FROM verdict"""
ORACLES["verify_chain"] = EV + VERDICT + " " + _verify
ORACLES["verify_intact_chain"] = EV + """ SELECT TRUE AS valid, count(*) AS checked_events, count(*) AS hashed_events, CAST(0 AS BIGINT) AS legacy_events,
  CAST(0 AS BIGINT) AS invalid_events, 'VALID' AS status FROM ev"""
def _tree_level(n: int, child: str) -> str:
    return f"""SELECT CAST({n} AS INT) AS level, pos // 64 AS pos, CAST(sum(n) AS BIGINT) AS n,
      sha256('{n}:' || (pos // 64) || chr(10) || string_agg(pos || ':' || digest, chr(10) ORDER BY pos, digest)) AS digest FROM {child} GROUP BY pos // 64"""


TREE = ", t0 AS (SELECT id AS pos, event_hash AS digest, 1 AS n FROM fold), " + ", ".join(
    f"t{k} AS (SELECT * FROM ({_tree_level(k, f't{k - 1}')}) WHERE {k} = 1 OR (SELECT max(pos) FROM t{k - 1}) > 0)" for k in (1, 2, 3, 4, 5)
)
ORACLES["hash_tree"] = EV + CHAIN + TREE + """ SELECT level, pos AS "at", n, digest FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3
  UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5)"""
# Rows by 64 ids: how many are stored, how many are there after each loss, and whether hashes were made anew.
_LOSS = """, cut AS (SELECT (id - 1) // 256 AS seg, min(id) AS first FROM ev WHERE id % 500 = 7 GROUP BY 1),
  lo AS (SELECT id // 64 AS pos, count(*) AS n, count(*) FILTER (WHERE id % 256 <> 0) AS tail, count(*) FILTER (WHERE (id - 1) // 256 <> 1) AS segment,
    count(*) FILTER (WHERE id % 500 <> 7) AS rebuilt, coalesce(bool_or(id >= first), FALSE) AS anew FROM ev LEFT JOIN cut ON seg = (id - 1) // 256 GROUP BY 1),
  df AS (SELECT pos, n, x.loss, x.found FROM lo, LATERAL (SELECT 'tail' AS loss, tail AS found, FALSE AS other UNION ALL SELECT 'segment', segment, FALSE
    UNION ALL SELECT 'rebuilt', rebuilt, anew) x WHERE x.found <> n OR x.other)"""
ORACLES["lost_rows"] = EV + _LOSS + """ SELECT pos * 64 AS first_id, pos * 64 + 63 AS last_id, n AS stored_rows, found AS found_rows,
  CASE WHEN found = 0 THEN 'lost' WHEN found < n THEN 'shrunk' ELSE 'changed' END AS what, loss FROM df"""
ORACLES["verify_with_tree"] = EV + _LOSS + """, k AS (SELECT unnest(['none', 'tail', 'segment', 'rebuilt']) AS loss),
  s AS (SELECT loss, count(*) AS blocks, CAST(sum(n - found) AS BIGINT) AS missing FROM df GROUP BY 1),
  c AS (SELECT k.loss, coalesce(blocks, 0) AS changed_blocks, coalesce(missing, 0) AS missing_events, (SELECT count(*) FROM ev) - coalesce(missing, 0) AS c FROM k LEFT JOIN s USING (loss))
  SELECT loss, loss = 'none' AS valid, c AS checked_events, c AS hashed_events, CAST(0 AS BIGINT) AS legacy_events, CAST(0 AS BIGINT) AS invalid_events,
    CASE WHEN loss = 'none' THEN 'VALID' ELSE 'INVALID' END AS status, loss = 'none' AS root_matches, changed_blocks, missing_events, CAST(0 AS BIGINT) AS added_events FROM c"""
ORACLES["tree_paths"] = EV + " SELECT id, TRUE AS proved, FALSE AS forged_proved, FALSE AS moved_proved FROM ev WHERE id % 100 = 0"
LABELS = VERDICT + """, lab AS (SELECT st.id, CASE WHEN event_hash IS NULL THEN 'LEGACY' WHEN reasons <> '' THEN 'TAMPERED' ELSE 'VERIFIED' END AS integrity
  FROM st JOIN verdict USING (id))"""
ORACLES["integrity_labels"] = EV + LABELS + " SELECT id, integrity FROM lab"

# -- correlation: every pair inside the window, then a closure over the links ----------------------------------

RELATED = """, rel(x, y, why) AS (VALUES ('usb', 'usb', 'related usb events'), ('file', 'file', 'related file events'),
    ('file', 'usb', 'known event-type relationship (file + usb)'), ('browser', 'file', 'known event-type relationship (browser + file)'),
    ('defender', 'file', 'known event-type relationship (defender + file)'), ('defender', 'usb', 'known event-type relationship (defender + usb)'),
    ('file', 'windows', 'known event-type relationship (file + windows)'), ('usb', 'windows', 'known event-type relationship (usb + windows)'),
    ('defender', 'windows', 'known event-type relationship (defender + windows)'), ('browser', 'windows', 'known event-type relationship (browser + windows)'))"""


def correlation(
    table: str = "ev", window: int = 300, scope: str = "0", smallest: int = 2, extra: str = "", key: str = "CAST(id AS VARCHAR)"
) -> str:
    lanes = ", ".join(f"CAST(sum(CAST('0x' || substr(sha256({key}), {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
    set_hash = f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {lanes}))"
    return RELATED + f""", f0 AS (SELECT *, {scope} AS g, {category()} AS cat, {RANK} AS rank, lower(rtrim(replace(file_path, '\\', '/'), '/')) AS np FROM {table} {extra}),
  f AS (SELECT *, regexp_extract(np, '^(.*)/', 1) AS dir FROM f0),
  lk AS (SELECT a.g, a.id AS aid, b.id AS bid, CASE WHEN a.device <> '' AND a.device = b.device THEN 'same device: ' || a.device END AS r_dev,
      CASE WHEN a."user" <> '' AND a."user" = b."user" THEN 'same user: ' || a."user" END AS r_user,
      CASE WHEN a.file_path <> '' AND b.file_path <> '' THEN CASE WHEN a.np = b.np THEN 'same file path: ' || a.file_path
        WHEN a.dir <> '' AND a.dir = b.dir THEN 'related file path (same directory): ' || a.dir END END AS r_file, rel.why AS r_type
    FROM f a JOIN f b ON a.g = b.g AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {window} SECOND AND (b.ts > a.ts OR b.id > a.id)
      AND (a.device = '' OR b.device = '' OR a.device = b.device)
    LEFT JOIN rel ON rel.x = least(a.cat, b.cat) AND rel.y = greatest(a.cat, b.cat)),
  link AS (SELECT * FROM lk WHERE coalesce(r_dev, r_user, r_file, r_type) IS NOT NULL),
  edge AS (SELECT g, aid AS x, bid AS y FROM link UNION SELECT g, bid, aid FROM link),
  reach(g, id, root) AS (SELECT DISTINCT g, x, x FROM edge UNION SELECT e.g, e.y, r.root FROM reach r JOIN edge e ON e.g = r.g AND e.x = r.id),
  comp AS (SELECT g, id, min(root) AS c FROM reach GROUP BY 1, 2),
  mem AS (SELECT comp.c, f.* FROM comp JOIN f USING (g, id)),
  named AS (SELECT g, c, 'INC-' || substr({set_hash}, 1, 12) AS incident_id, count(*) AS event_count
    FROM mem GROUP BY 1, 2 HAVING count(*) >= {smallest}),
  why AS (SELECT DISTINCT l.g, comp.c, s.signal, s.reason FROM link l JOIN comp ON comp.g = l.g AND comp.id = l.aid, LATERAL (
      SELECT 'device' AS signal, r_dev AS reason UNION ALL SELECT 'user', r_user UNION ALL SELECT 'file', r_file
      UNION ALL SELECT 'type_relationship', r_type UNION ALL SELECT 'temporal', 'temporal proximity (within {window}s window)') s WHERE s.reason IS NOT NULL),
  sig AS (SELECT g, c, string_agg(DISTINCT signal, '|' ORDER BY signal) AS confidence_signals, count(DISTINCT signal) AS confidence_score FROM why GROUP BY 1, 2),
  prof AS (SELECT g, c, min(ts) AS start_time, max(ts) AS end_time, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
      string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS event_types, bool_or(cat = 'defender') AS d, bool_or(cat = 'file') AS fi, bool_or(cat = 'usb') AS us,
      coalesce(max(rank) FILTER (WHERE cat = 'defender'), 0) AS dr, coalesce(max(rank) FILTER (WHERE cat = 'windows'), 0) AS wr, max(rank) AS mr FROM mem GROUP BY 1, 2),
  pri AS (SELECT *, CASE WHEN d AND fi AND dr >= 2 THEN 'CRITICAL' WHEN d THEN 'HIGH' WHEN mr >= 3 THEN 'HIGH' WHEN us AND fi THEN 'MEDIUM' WHEN wr >= 1 THEN 'MEDIUM'
    ELSE 'LOW' END AS priority FROM prof)"""


_inc = " SELECT incident_id, start_time, end_time, event_count, sources, event_types, priority, confidence_score, confidence_signals FROM named JOIN pri USING (g, c) JOIN sig USING (g, c)"
ORACLES["incidents"] = EV + correlation() + _inc
ORACLES["incidents_bridged"] = EVM + correlation() + _inc
ORACLES["incidents_without_ids"] = EVM + correlation(key="""CASE WHEN id % 5 = 0 THEN 'row:' || sha256(concat_ws(chr(31), CAST(epoch_us(ts) AS VARCHAR),
  source, event_type, description, severity, "user", device, file_path, metadata)) ELSE CAST(id AS VARCHAR) END""") + _inc
ORACLES["incident_report"] = EV + correlation() + """, inc AS (SELECT incident_id, start_time, event_count FROM named JOIN pri USING (g, c))
  SELECT CAST(row_number() OVER (ORDER BY start_time, incident_id) AS INT) AS position, * FROM inc QUALIFY position <= 100"""
ORACLES["incident_members"] = EV + correlation() + " SELECT incident_id, id AS event_id, ts FROM named JOIN mem USING (g, c)"
ORACLES["bridged_members"] = EVM + correlation() + " SELECT incident_id, id AS event_id FROM named JOIN mem USING (g, c)"
ORACLES["incident_event_lists"] = EV + correlation() + """ SELECT incident_id, CAST(0 AS INT) AS part, string_agg(CAST(id AS VARCHAR), '|' ORDER BY ts, id) AS event_ids
  FROM named JOIN mem USING (g, c) GROUP BY 1"""
_why = " SELECT incident_id, signal, reason FROM named JOIN why USING (g, c)"
ORACLES["pair_signals"] = EV + correlation() + _why
ORACLES["bridged_signals"] = EVM + correlation() + _why
ORACLES["incident_signals"] = EV + correlation(window=900) + " SELECT incident_id, confidence_score, confidence_signals FROM named JOIN sig USING (g, c)"
ORACLES["incident_priority"] = EV + correlation(window=600, smallest=3) + " SELECT incident_id, event_count, priority FROM named JOIN pri USING (g, c)"
ORACLES["incident_integrity"] = EV + LABELS + correlation("st") + """ SELECT incident_id, count(*) FILTER (WHERE integrity = 'LEGACY') AS n_legacy,
    CAST(0 AS BIGINT) AS n_hashed_unverified, count(*) FILTER (WHERE integrity = 'VERIFIED') AS n_verified,
    count(*) FILTER (WHERE integrity = 'TAMPERED') AS n_tampered FROM named JOIN mem USING (g, c) JOIN lab USING (id) GROUP BY 1"""
ORACLES["device_session_rows"] = EV + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 300 SECOND THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY device ORDER BY ts, id)),
  n AS (SELECT *, sum(s) OVER (PARTITION BY device ORDER BY ts, id) AS sid FROM g)
  SELECT device, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_events FROM n GROUP BY device, sid"""

# -- baseline and scores -------------------------------------------------------------------------------------


def feats(name: str, table: str, where: str = "TRUE") -> str:
    return f""", {name} AS (SELECT id, source, event_type, {category()} AS cat, severity AS sev, "user" AS u, device AS dv, hour(ts) AS h,
    CAST(isodow(ts) - 1 AS INT) AS wd FROM {table} WHERE {where})"""


_dims = " UNION ALL ".join(
    f"SELECT '{d}' AS dim, {c} AS value FROM b"
    for d, c in (("source", "source"), ("event_type", "event_type"), ("category", "cat"), ("severity", "sev"), ("user", "u"), ("device", "dv"))
)
BASE = f""", cnt AS (SELECT dim, value, count(*) AS n FROM ({_dims}) WHERE value <> '' GROUP BY 1, 2), tot AS (SELECT count(*) AS t FROM b),
  sub AS (SELECT 'user' AS scope, u AS subject, h, count(*) AS n FROM b WHERE u <> '' GROUP BY 2, 3
    UNION ALL SELECT 'device', dv, h, count(*) FROM b WHERE dv <> '' GROUP BY 2, 3 UNION ALL SELECT 'all', '', h, count(*) FROM b GROUP BY 3),
  grid AS (SELECT scope, subject, g.i AS h, coalesce(n, 0) AS n FROM (SELECT DISTINCT scope, subject FROM sub) s CROSS JOIN range(24) AS g(i) LEFT JOIN sub USING (scope, subject, h)),
  stat AS (SELECT scope, subject, sum(n) AS total, sum(n) / 24.0 AS mean, stddev_pop(n) AS std FROM grid GROUP BY 1, 2)"""
BASE = BASE.replace("range(24) AS g(i) LEFT JOIN sub USING (scope, subject, h)", "range(24) AS g(i) LEFT JOIN sub ON sub.scope = s.scope AND sub.subject = s.subject AND sub.h = g.i").replace(
    "SELECT scope, subject, g.i AS h, coalesce", "SELECT s.scope, s.subject, g.i AS h, coalesce"
)


def scores(suspicious: int = 30, min_events: int = 20) -> str:
    def w(dim, col, unseen, rare, cond):
        n = f"coalesce((SELECT n FROM cnt WHERE dim = '{dim}' AND value = {col}), 0)"
        return f"CASE WHEN {cond} THEN CASE WHEN {n} = 0 THEN {unseen} WHEN {n} / t < 0.05 THEN {rare} ELSE 0 END ELSE 0 END"

    return BASE + f""", pick AS (SELECT e.*, CASE WHEN us.total >= 5 THEN us.scope WHEN ds.total >= 5 THEN ds.scope ELSE 'all' END AS sc,
      CASE WHEN us.total >= 5 THEN u WHEN ds.total >= 5 THEN dv ELSE '' END AS sj FROM e LEFT JOIN stat us ON us.scope = 'user' AND us.subject = u
      LEFT JOIN stat ds ON ds.scope = 'device' AND ds.subject = dv),
  sg AS (SELECT p.id, t, {w('category', 'cat', 35, 12, "cat <> 'other'")} AS w_category, {w('source', 'source', 40, 15, "cat = 'other' AND source <> ''")} AS w_source,
      {w('event_type', 'event_type', 30, 12, "event_type <> ''")} AS w_type, {w('user', 'u', 30, 12, "u <> ''")} AS w_user,
      {w('device', 'dv', 30, 10, "dv <> ''")} AS w_device, {w('severity', 'sev', 25, 10, "sev <> ''")} AS w_severity,
      CASE WHEN st.total > 0 AND gr.n = 0 THEN 30 ELSE 0 END AS w_hour,
      CASE WHEN gr.n > 0 AND st.std > 0 AND (gr.n - st.mean) / st.std <= -2 THEN 20 ELSE 0 END AS w_freq,
      CASE WHEN t > 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.wd = p.wd) THEN 10 ELSE 0 END AS w_day
    FROM pick p CROSS JOIN tot LEFT JOIN stat st ON st.scope = sc AND st.subject = sj LEFT JOIN grid gr ON gr.scope = sc AND gr.subject = sj AND gr.h = p.h),
  sc0 AS (SELECT *, CASE WHEN t < {min_events} THEN 0 ELSE least(100, w_category + w_source + w_type + w_user + w_device + w_severity + w_hour + w_freq + w_day) END AS s FROM sg),
  scored AS (SELECT id, CAST(s AS DOUBLE) AS anomaly_score, CASE WHEN t < {min_events} THEN 'INSUFFICIENT_HISTORY' WHEN s >= 60 THEN 'ANOMALOUS' WHEN s >= {suspicious} THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS classification,
      CASE WHEN t < {min_events} THEN 'INFO' WHEN s >= 60 THEN 'HIGH' WHEN s >= {suspicious} THEN 'WARNING' ELSE 'INFO' END AS severity,
      CASE WHEN t < {min_events} THEN '' ELSE concat_ws('|', CASE WHEN w_category > 0 THEN 'unusual_category' END, CASE WHEN w_day > 0 THEN 'unusual_day' END,
        CASE WHEN w_device > 0 THEN 'unusual_device' END, CASE WHEN w_type > 0 THEN 'unusual_event_type' END, CASE WHEN w_freq > 0 THEN 'unusual_frequency' END,
        CASE WHEN w_hour > 0 THEN 'unusual_hour' END, CASE WHEN w_severity > 0 THEN 'unusual_severity' END, CASE WHEN w_source > 0 THEN 'unusual_source' END,
        CASE WHEN w_user > 0 THEN 'unusual_user' END) END AS signals, w_device FROM sc0)"""


_self = EV + feats("b", "ev") + ", e AS (SELECT * FROM b)"
_score_cols = " SELECT id, anomaly_score, classification, severity, signals FROM scored"
ORACLES["baseline_categorical"] = _self + BASE + " SELECT dim, value, n FROM cnt"
ORACLES["baseline_hours"] = _self + " SELECT CAST(h AS INT) AS hour, count(*) AS n FROM b GROUP BY 1"
ORACLES["baseline_days"] = _self + " SELECT wd AS weekday, count(*) AS n FROM b GROUP BY 1"
ORACLES["baseline_subject_hours"] = _self + BASE + " SELECT scope, subject, CAST(h AS INT) AS hour, n FROM sub WHERE scope <> 'all'"
ORACLES["baseline_hour_stats"] = _self + BASE + " SELECT round(mean, 4) AS hourly_mean, round(std, 4) AS hourly_std FROM stat WHERE scope = 'all'"
ORACLES["baseline_status"] = _self + """ SELECT count(*) AS total_events, count(*) AS timestamped_events,
  CASE WHEN count(*) >= 20 THEN 'ready' ELSE 'insufficient_history' END AS status FROM b"""
ORACLES["anomaly_scores"] = _self + scores() + _score_cols
ORACLES["anomalies"] = _self + scores(20) + _score_cols + " WHERE classification IN ('SUSPICIOUS', 'ANOMALOUS')"
ORACLES["anomaly_cold_start"] = _self + scores(min_events=10**9) + _score_cols
ORACLES["anomaly_reasons"] = _self + scores() + """ SELECT id, CAST(greatest(1, len(list_filter(string_split(signals, '|'), lambda x: x <> ''))) AS INT) AS n_reasons,
  signals, w_device > 0 AS names_device FROM scored"""
ORACLES["anomaly_class_counts"] = _self + scores() + """ SELECT c AS classification, count(scored.id) AS n FROM (VALUES ('NORMAL'), ('SUSPICIOUS'), ('ANOMALOUS'),
  ('INSUFFICIENT_HISTORY')) v(c) LEFT JOIN scored ON classification = c GROUP BY 1"""
ORACLES["anomaly_holdout"] = EVM + feats("b", "ev", "ts < TIMESTAMP '2024-01-08' AND source <> 'USB'") + feats("e", "ev") + scores() + _score_cols
_dashboard = _self + scores() + correlation() + """ SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT max(ts) FROM ev) AS latest_event_time,
  (SELECT count(*) FROM named) AS candidate_incident_count, (SELECT count(*) FROM scored WHERE classification IN ('SUSPICIOUS', 'ANOMALOUS')) AS behavioral_anomaly_count,
  'VALID' AS integrity_status"""
_counted = "(SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM (SELECT coalesce({0}, '') AS v, count(*) AS n FROM ev GROUP BY 1)) AS by_{0}"
_dashboard += ", " + _counted.format("source") + ", " + _counted.format("severity")
_whole = ", ".join(f"""'{c}': coalesce("{c}", '')""" for c in TEXT_COLUMNS)
ORACLES["dashboard_summary"] = _dashboard + f""",
  (SELECT {js(f"list({{'id': id, 'ts': {iso()}, {_whole}}} ORDER BY ts DESC, id DESC)")} FROM (SELECT * FROM ev ORDER BY ts DESC, id DESC LIMIT 10)) AS recent_events"""
ORACLES["dashboard_full"] = _dashboard + """,
  (SELECT string_agg(id || ',' || source || ',' || event_type || ',' || coalesce(severity, '') || ',' || coalesce("user", '') || ',' || coalesce(device, ''), '|'
    ORDER BY ts DESC, id DESC) FROM (SELECT * FROM ev ORDER BY ts DESC, id DESC LIMIT 10)) AS recent_events"""

# -- cases ---------------------------------------------------------------------------------------------------

CASE = EV + LABELS + REQ + hits("st") + """, evid AS (SELECT hit.*, CASE WHEN event_hash IS NULL THEN 'LEGACY' WHEN NOT with_integrity THEN 'HASHED_UNVERIFIED' ELSE integrity END AS label
  FROM hit JOIN lab USING (id))"""
_corr = correlation("evid", scope="case_id", extra="WHERE with_correlation")
_behav = feats("b", "st") + f""", e AS (SELECT id, source, event_type, {category()} AS cat, severity AS sev, "user" AS u, device AS dv, hour(ts) AS h,
    CAST(isodow(ts) - 1 AS INT) AS wd FROM (SELECT DISTINCT ON (id) * FROM evid WHERE with_behavior))""" + scores() + """, odd AS (SELECT e.case_id, s.*, e.ts, e.source, e.event_type
    FROM evid e JOIN scored s USING (id) WHERE e.with_behavior AND classification IN ('SUSPICIOUS', 'ANOMALOUS'))"""
_facts = _corr + _behav + """, ver AS (""" + _verify + """),
  ef AS (SELECT case_id, count(*) AS n, min(ts) AS t0, max(ts) AS t1, string_agg(DISTINCT source, '|' ORDER BY source) AS srcs,
      string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, count(*) FILTER (WHERE label = 'LEGACY') AS leg, count(*) FILTER (WHERE source = 'Browser') AS br FROM evid GROUP BY 1),
  fact AS (SELECT q.case_id, question, warning, coalesce(n, 0) AS n, t0, t1, coalesce(srcs, '') AS srcs, coalesce(types, '') AS types, coalesce(n, 0) >= max_rows AS truncated,
      coalesce(leg, 0) AS leg, coalesce(br, 0) AS br, with_behavior, with_integrity,
      (SELECT count(*) FROM named WHERE g = q.case_id) AS inc, (SELECT count(*) FROM odd WHERE odd.case_id = q.case_id) AS ano,
      (SELECT string_agg(DISTINCT classification, ', ' ORDER BY classification) FROM odd WHERE odd.case_id = q.case_id) AS classes,
      CASE WHEN with_behavior THEN CASE WHEN (SELECT t FROM tot) >= 20 THEN 'ready' ELSE 'insufficient_history' END END AS bstat,
      CASE WHEN with_integrity THEN ver.valid END AS valid, ver.checked_events AS ck, ver.hashed_events AS ha, ver.legacy_events AS le, ver.invalid_events AS iv
    FROM req q LEFT JOIN ef USING (case_id) CROSS JOIN ver WHERE error IS NULL)"""
FACT = CASE + _facts
ORACLES["evidence"] = CASE + " SELECT case_id, id AS event_id, TRUE AS db_backed, ts, source, severity, label AS integrity, 'event ' || id AS reference FROM evid"
ORACLES["evidence_lines"] = CASE + f""" SELECT case_id, row_no AS line_no, '- [event ' || id || '] ' || {iso()} || ' ' || source || '/' || event_type || ' (' || severity || '): ' || description
  || ' [' || concat_ws(', ', CASE WHEN "user" <> '' THEN 'user=' || "user" END, CASE WHEN device <> '' THEN 'device=' || device END,
    CASE WHEN file_path <> '' THEN 'path=' || file_path END, 'integrity=' || label) || ']' AS line FROM evid WHERE row_no <= 200"""
ORACLES["case_timeline"] = CASE + """, t AS (SELECT case_id, id, row_no, CASE WHEN NOT contains(description, 'file5') THEN ts END AS tt FROM evid)
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY tt NULLS LAST, row_no) - 1 AS position, id AS event_id, tt IS NOT NULL AS has_timestamp FROM t"""
ORACLES["case_package"] = FACT + """ SELECT case_id, n AS evidence_count, inc AS incident_count, ano AS anomaly_count, bstat AS baseline_status, CAST(valid AS VARCHAR) AS chain_valid, truncated FROM fact"""
ORACLES["case_facts"] = FACT + " SELECT case_id, n AS evidence_count, t0 AS first_time, t1 AS last_time, CAST(0 AS BIGINT) AS untimed, srcs AS found_sources, types AS found_types FROM fact"
ORACLES["case_report_id"] = CASE + f""", i AS (SELECT case_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM evid GROUP BY 1)
  SELECT case_id, 'RPT-' || substr(sha256(question || '|' || coalesce(ids, '') || '|' || coalesce({iso('t0')}, '') || '|' || coalesce({iso('t1')}, '') || '|' || coalesce(n, 0)), 1, 12) AS report_id
  FROM req LEFT JOIN i USING (case_id) WHERE error IS NULL"""
_lit = lambda s: "'" + s.replace("'", "''") + "'"
ORACLES["case_summary"] = FACT + f""", per AS (SELECT case_id, source || '=' || count(*) AS x FROM evid GROUP BY case_id, source),
  bd AS (SELECT case_id, string_agg(x, ', ' ORDER BY x) AS breakdown FROM per GROUP BY 1)
  SELECT case_id, CASE WHEN n = 0 THEN {_lit(K.NO_EVIDENCE_MESSAGE)} ELSE concat_ws(' ', 'Retrieved ' || n || ' matching event(s) [' || breakdown || '].',
    'Time range: ' || {iso('t0')} || ' to ' || {iso('t1')} || '.',
    CASE WHEN inc > 0 THEN inc || ' candidate incident(s) of related events (correlation, not proof of an attack).' END,
    CASE WHEN ano > 0 THEN ano || ' event(s) deviate from the behavioral baseline (review-worthy, not confirmed malicious).'
      WHEN bstat = 'insufficient_history' THEN 'Behavioral baseline has insufficient history to assess anomalies.' END,
    CASE WHEN valid THEN 'Integrity: hash chain intact for the checked events.' WHEN NOT valid THEN 'Integrity: chain verification found issues (' || iv || ' records).' END) END AS summary
  FROM fact LEFT JOIN bd USING (case_id)"""
ORACLES["case_integrity"] = FACT + f""", lc AS (SELECT case_id, count(*) FILTER (WHERE label = 'LEGACY') AS a, count(*) FILTER (WHERE label = 'HASHED_UNVERIFIED') AS b1,
    count(*) FILTER (WHERE label = 'VERIFIED') AS c1, count(*) FILTER (WHERE label = 'TAMPERED') AS d1 FROM evid GROUP BY 1)
  SELECT case_id, with_integrity AS available, CAST(valid AS VARCHAR) AS valid, CASE WHEN with_integrity THEN ck ELSE 0 END AS checked_events, CASE WHEN with_integrity THEN ha ELSE 0 END AS hashed_events,
    CASE WHEN with_integrity THEN le ELSE 0 END AS legacy_events, CASE WHEN with_integrity THEN iv ELSE 0 END AS invalid_events,
    CASE WHEN NOT with_integrity THEN {_lit(K.NOT_VERIFIED)} ELSE CASE WHEN valid THEN {_lit(K.CONSISTENT_CHAIN)} ELSE 'Hash-chain verification found ' || iv || ' record(s) that failed integrity checks.' END
      || CASE WHEN le > 0 THEN ' ' || le || ' legacy event(s) predate hash-chaining and could not be cryptographically verified.' ELSE '' END END AS summary,
    coalesce(a, 0) AS "LEGACY", coalesce(b1, 0) AS "HASHED_UNVERIFIED", coalesce(c1, 0) AS "VERIFIED", coalesce(d1, 0) AS "TAMPERED" FROM fact LEFT JOIN lc USING (case_id)"""
ORACLES["case_correlation"] = CASE + _corr + """, ids AS (SELECT g, c, string_agg(CAST(id AS VARCHAR), '|' ORDER BY ts, id) AS event_ids, count(*) FILTER (WHERE label = 'VERIFIED') AS n_verified,
    count(*) FILTER (WHERE label = 'TAMPERED') AS n_tampered, count(*) FILTER (WHERE label = 'HASHED_UNVERIFIED') AS n_hashed_unverified FROM mem GROUP BY 1, 2),
  rs AS (SELECT g, c, string_agg(DISTINCT reason, '|' ORDER BY reason) AS correlation_reasons FROM why GROUP BY 1, 2)
  SELECT g AS case_id, incident_id, start_time, end_time, event_count, priority, confidence_score, event_ids, correlation_reasons, n_verified, n_tampered, n_hashed_unverified
  FROM named JOIN pri USING (g, c) JOIN sig USING (g, c) JOIN ids USING (g, c) JOIN rs USING (g, c)"""
ORACLES["case_behavior"] = CASE + _behav + f""" SELECT case_id, id AS event_id, classification, anomaly_score, severity, signals, 'event ' || id AS event_reference, {iso()} AS timestamp, source, event_type FROM odd"""
ORACLES["case_warnings"] = FACT + f""", w AS (SELECT case_id, list_filter([warning, CASE WHEN truncated THEN {_lit(K.TRUNCATED)} END], lambda x: x IS NOT NULL) AS l FROM fact)
  SELECT case_id, CAST(i AS INT) AS position, l[i + 1] AS warning FROM w, range(2) AS r(i) WHERE i < len(l)"""
ORACLES["case_limitations"] = FACT + f""", w AS (SELECT case_id, list_filter([{_lit(K.LIMIT_SCOPE)}, CASE WHEN inc > 0 THEN {_lit(K.LIMIT_CORRELATION)} END,
    CASE WHEN with_behavior THEN {_lit(K.LIMIT_BEHAVIOR)} END, CASE WHEN bstat = 'insufficient_history' THEN {_lit(K.LIMIT_BASELINE)} END,
    CASE WHEN with_integrity THEN {_lit(K.LIMIT_INTEGRITY)} END, CASE WHEN leg > 0 THEN {_lit(K.LIMIT_LEGACY)} END, CASE WHEN br > 0 THEN {_lit(K.LIMIT_BROWSER)} END],
    lambda x: x IS NOT NULL) AS l FROM fact) SELECT case_id, CAST(i AS INT) AS position, l[i + 1] AS limitation FROM w, range(7) AS r(i) WHERE i < len(l)"""
_span = f"CASE WHEN t0 IS NULL THEN '' WHEN t0 = t1 THEN ' at ' || {iso('t0')} ELSE ' between ' || {iso('t0')} || ' and ' || {iso('t1')} END"
ORACLES["case_sentences"] = FACT + f""" SELECT case_id, CASE WHEN n = 0 THEN {_lit(K.NO_EVIDENCE_SUMMARY)} ELSE 'The investigation retrieved ' || n || ' event(s)' || {_span} || ' from source(s): ' || replace(srcs, '|', ', ') || '.'
    || CASE WHEN inc > 0 THEN ' ' || inc || ' candidate incident(s) of related events were identified through correlation (related events, not a confirmed attack).' ELSE '' END
    || CASE WHEN ano > 0 THEN ' ' || ano || ' event(s) deviated from the available behavioral baseline (review-worthy, not confirmed malicious activity).'
      WHEN bstat = 'insufficient_history' THEN ' Behavioral baseline history was insufficient to assess anomalies.' ELSE '' END
    || CASE WHEN valid THEN ' The checked hash chain was internally consistent.' WHEN NOT valid THEN ' Hash-chain verification reported integrity issues.' ELSE '' END END AS executive_summary,
  CASE WHEN n = 0 THEN {_lit(K.NO_EVIDENCE_CONCLUSION)} ELSE concat_ws(' ', 'The available evidence shows ' || n || ' event(s)' || {_span} || ' from source(s): ' || replace(srcs, '|', ', ') || '.',
    CASE WHEN inc > 0 THEN 'The correlation engine identified ' || inc || ' candidate incident(s) of related events; this establishes a relationship between the events, not a confirmed attack, intrusion, or intent.' END,
    CASE WHEN ano > 0 THEN 'The behavioral engine classified ' || ano || ' event(s) as ' || classes || ' relative to the available baseline; this indicates deviation from observed patterns, not confirmed malicious activity.'
      WHEN bstat = 'insufficient_history' THEN 'The behavioral baseline had insufficient history, so no reliable anomaly determination was made.' END,
    CASE WHEN valid THEN 'The integrity check found the checked hash chain to be internally consistent.' WHEN NOT valid THEN 'The integrity check found ' || iv || ' record(s) that failed verification.'
      ELSE 'Cryptographic integrity verification was not performed for this evidence.' END) END AS conclusion FROM fact"""
ORACLES["case_buckets"] = FACT + """ SELECT case_id, 'observed_facts' AS bucket, CAST(CASE WHEN n = 0 THEN 1 ELSE 3 END AS BIGINT) AS n FROM fact
  UNION ALL SELECT case_id, 'correlation_findings', inc FROM fact WHERE inc > 0 UNION ALL SELECT case_id, 'behavioral_findings', ano FROM fact WHERE ano > 0
  UNION ALL SELECT case_id, 'integrity_findings', 1 FROM fact"""

# -- cursors -------------------------------------------------------------------------------------------------

ORACLES["hwm_incremental"] = EV + """, w AS (SELECT 'Channel' || (id % 3) AS channel, id AS rn FROM ev WHERE source = 'Windows'),
  hi AS (SELECT channel, max(rn) AS hi FROM w GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY rn DESC) AS p FROM w)
  SELECT 'admitted' AS what, channel, rn AS record_number FROM n JOIN hi USING (channel) WHERE CASE WHEN channel = 'Channel0' THEN rn > hi // 2 ELSE p <= 30 END
  UNION ALL SELECT 'cursor', channel, hi FROM hi"""
ORACLES["browser_incremental"] = EV + _history + """, v AS (SELECT DISTINCT browser || '::' || profile AS pk, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, url FROM hist),
  cu AS (SELECT pk, CAST(CAST(max(ts) AS DATE) - 3 AS TIMESTAMP) AS old FROM v WHERE pk <> 'Edge::P1' GROUP BY 1),
  bo AS (SELECT pk, substr(sha256(url), 1, 16) AS key FROM v JOIN cu USING (pk) WHERE ts = old AND length(url) % 2 = 0),
  r AS (SELECT v.*, old, substr(sha256(url), 1, 16) AS key FROM v LEFT JOIN cu USING (pk) WHERE ts IS NOT NULL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, url) AS n FROM r WHERE old IS NULL),
  mv AS (SELECT pk, greatest(max(ts), max(old)) AS last, max(old) AS old FROM r GROUP BY 1)
  SELECT 'admitted' AS what, pk AS profile_key, ts, url AS item FROM r WHERE ts > old OR (ts = old AND (pk, key) NOT IN (SELECT pk, key FROM bo))
  UNION ALL SELECT 'admitted', pk, ts, url FROM fr WHERE n <= 10
  UNION ALL SELECT 'cursor', pk, last, '' FROM mv
  UNION ALL SELECT DISTINCT 'boundary', pk, NULL, key FROM (SELECT r.pk, r.key FROM r JOIN mv ON mv.pk = r.pk AND r.ts = mv.last
    UNION SELECT bo.pk, bo.key FROM bo JOIN mv ON mv.pk = bo.pk AND mv.last = mv.old)"""

# -- streams -------------------------------------------------------------------------------------------------

ORACLES["stream_ingest"] = ORACLES["normalize"]
ORACLES["stream_scores"] = ORACLES["anomaly_holdout"]
ORACLES["stream_counters"] = ORACLES["source_stats"]
ORACLES["stream_incidents"] = "SELECT * FROM (" + ORACLES["device_session_rows"] + ") WHERE n_events >= 2"
ORACLES["stream_hwm"] = EV + " SELECT 'Channel' || (id % 3) AS channel, id AS record_number, ts FROM ev WHERE source = 'Windows'"
ORACLES["stream_dedup"] = ORACLES["stream_hwm"]
ORACLES["stream_browser"] = EV + _history + """ SELECT DISTINCT browser || '::' || profile AS profile_key, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, url
  FROM hist WHERE ts IS NOT NULL"""
ORACLES["stream_record_state"] = EV + """, w AS (SELECT 'Channel' || (id % 3) AS channel, id AS record_number, ts FROM ev WHERE source = 'Windows')
  SELECT channel, record_number, ts FROM w WHERE channel <> 'Channel0' OR record_number > (SELECT max(record_number) // 2 FROM w WHERE channel = 'Channel0')"""
ORACLES["stream_visit_state"] = EV + _history + """ SELECT profile_key, ts, url FROM (SELECT DISTINCT browser || '::' || profile AS profile_key,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, url FROM hist WHERE ts IS NOT NULL) v
  WHERE profile_key <> 'Edge::P1' OR ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND length(url) % 2 = 1)"""
ORACLES["stream_incidents_revised"] = ORACLES["incidents_bridged"]
_ledger = EV + _normal + """, un AS (SELECT id % 3 AS poll, t, source, event_type, description, "user", device, file_path, k, min(id) AS first FROM n0 WHERE reason IS NULL
    GROUP BY ALL), led AS (SELECT row_number() OVER (ORDER BY poll, t, first) AS id, * EXCLUDE (poll) FROM un)"""
ORACLES["stream_ledger"] = _ledger + """ SELECT id, t AS ts, source, event_type, description, file_path, CAST((id - 1) // 256 AS VARCHAR) AS chain FROM led"""
ORACLES["stream_ledger_stats"] = _ledger + """, raw AS (SELECT CASE WHEN reason = 'source is required' THEN '' ELSE source END AS source, reason FROM n0),
  got AS (SELECT source, count(*) AS c FROM led GROUP BY 1)
  SELECT raw.source, count(*) AS received, coalesce(any_value(c), 0) AS inserted, count(*) FILTER (WHERE reason IS NULL) - coalesce(any_value(c), 0) AS duplicates,
    count(*) FILTER (WHERE reason LIKE 'description%') AS skipped, count(*) FILTER (WHERE reason NOT LIKE 'description%') AS errors FROM raw LEFT JOIN got USING (source) GROUP BY 1
  UNION ALL SELECT reason, NULL, count(*), NULL, NULL, NULL FROM n0 WHERE reason IS NOT NULL GROUP BY 1"""
ORACLES["stream_ledger_check"] = _ledger + """ SELECT TRUE AS valid, count(*) AS checked_events, count(*) AS hashed_events, CAST(0 AS BIGINT) AS legacy_events,
  CAST(0 AS BIGINT) AS invalid_events, 'VALID' AS status, TRUE AS root_matches, CAST(0 AS BIGINT) AS changed_blocks, CAST(0 AS BIGINT) AS missing_events, CAST(0 AS BIGINT) AS added_events FROM led"""
ORACLES["stream_rolling_baseline"] = EVM + feats("b", "ev", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'") + feats("e", "ev") + scores() + _score_cols
_fields = 'source, event_type, ts, description, severity, "user", device, file_path, metadata'
ORACLES["ingest_union_rows"] = " UNION ALL ".join(
    f"SELECT {_fields} FROM ({ORACLES[name]}) {cond}"
    for name, cond in (("src_windows", ""), ("src_defender", "WHERE NOT malformed"), ("src_usb", ""), ("src_browser", ""))
)
ORACLES["case_statements"] = f"""WITH f AS MATERIALIZED ({FACT} SELECT * FROM fact), i AS ({ORACLES['case_integrity']}), c AS ({ORACLES['case_correlation']})
  SELECT case_id, 'observed_facts' AS bucket, unnest(list_filter([CASE WHEN n = 0 THEN 'No evidence events were retrieved.' ELSE n || ' event(s) were retrieved from source(s): ' || replace(srcs, '|', ', ') || '.' END,
    'The earliest event occurred at ' || {iso('t0')} || ' and the latest at ' || {iso('t1')} || '.', CASE WHEN types <> '' THEN 'Observed event type(s): ' || replace(types, '|', ', ') || '.' END],
    lambda x: x IS NOT NULL)) AS statement FROM f
  UNION ALL SELECT case_id, 'correlation_findings', 'Candidate incident ' || incident_id || ' (' || priority || ' priority) groups events [' || replace(event_ids, '|', ', ') || '] as related because: '
    || replace(correlation_reasons, '|', '; ') || '.' FROM c
  UNION ALL SELECT case_id, 'integrity_findings', summary FROM i"""
