"""Fixed values of the event model."""

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("event_hash", T.StringType()),
        T.StructField("previous_hash", T.StringType()),
    ]
)

# Stored columns, in order.
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]
PUBLIC_COLUMNS = EVENT_COLUMNS[:10]
TEXT_COLUMNS = ["source", "event_type", "description", "severity", "user", "device", "file_path", "metadata"]

# Sources and categories.
SOURCES = ["USB", "FileSystem", "Browser", "Defender", "Windows"]
CATEGORIES = ["usb", "file", "browser", "defender", "windows", "other"]

# Category pairs that count as related.
RELATED_CATEGORIES = [
    ("usb", "usb"),
    ("file", "file"),
    ("usb", "file"),
    ("browser", "file"),
    ("file", "defender"),
    ("usb", "defender"),
    ("windows", "file"),
    ("windows", "usb"),
    ("windows", "defender"),
    ("windows", "browser"),
]

# Severities, their correlation rank and their display weight.
KNOWN_SEVERITIES = [
    "INFO", "LOW", "WARNING", "MEDIUM", "ERROR", "HIGH", "CRITICAL", "AUDIT_SUCCESS", "AUDIT_FAILURE",
]
SEVERITY_RANK = {"WARNING": 1, "MEDIUM": 1, "AUDIT_FAILURE": 1, "ERROR": 2, "HIGH": 2, "CRITICAL": 3}
SEVERITY_WEIGHT = {
    "CRITICAL": 7, "HIGH": 6, "ERROR": 5, "MEDIUM": 4, "WARNING": 3, "AUDIT_FAILURE": 3, "LOW": 2, "INFO": 1,
    "AUDIT_SUCCESS": 1,
}

# Integrity labels.
LEGACY = "LEGACY"
HASHED_UNVERIFIED = "HASHED_UNVERIFIED"
VERIFIED = "VERIFIED"
TAMPERED = "TAMPERED"
INTEGRITY_LABELS = [LEGACY, HASHED_UNVERIFIED, VERIFIED, TAMPERED]

# Score classes.
CLASSES = ["NORMAL", "SUSPICIOUS", "ANOMALOUS", "INSUFFICIENT_HISTORY"]
CLASS_SEVERITY = {"NORMAL": "INFO", "SUSPICIOUS": "WARNING", "ANOMALOUS": "HIGH", "INSUFFICIENT_HISTORY": "INFO"}

# Aliases of raw record keys, in order of preference.
FIELD_ALIASES = {
    "timestamp": ["timestamp", "time", "ts", "event_time", "datetime", "date", "TimeGenerated", "visit_time"],
    "source": ["source", "log_source"],
    "event_type": ["event_type", "type", "event_id", "EventID", "category", "action"],
    "description": ["description", "message", "Message", "desc", "summary", "title"],
    "severity": ["severity", "level", "Level", "priority"],
    "user": ["user", "user_name", "username", "account", "User"],
    "device": ["device", "device_name", "machine", "computer", "host", "hostname"],
    "file_path": ["file_path", "path", "path_or_url", "file", "target_path", "url"],
}

# Collectors and the keywords that claim a source for them.
COLLECTOR_KEYWORDS = {
    "windows": ["windows", "event", "eventlog", "security", "system"],
    "defender": ["defender", "antivirus", "threat"],
    "file": ["file", "filesystem", "ntfs"],
    "usb": ["usb", "removable"],
    "browser": ["browser", "chrome", "edge", "firefox"],
}
