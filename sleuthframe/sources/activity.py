"""Event table read from the activity stream table ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_OF = {"click": "Browser", "view": "FileSystem", "signup": "Windows", "purchase": "USB"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of a table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pick(col: Column, cases: dict, default) -> Column:
    out = None
    for key, value in cases.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def activity_events(spark: SparkSession, folder: str, missing_devices: bool = False) -> DataFrame:
    """Map the activity table to the event model.

    ``missing_devices`` leaves the device empty for some rows, as collectors without a host name do.
    """
    raw = read_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = raw.select(
        (F.col("event_id") + 1).alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("_a"),
        F.col("user_id").alias("_u"),
        F.col("value").alias("_v"),
        k.alias("_k"),
        F.col("props").alias("metadata"),
    )
    kind, n = F.col("_a"), F.col("_k")
    file_type = F.element_at(
        F.array(*[F.lit(x) for x in ("FILE_CREATED", "FILE_MODIFIED", "FILE_DELETED", "FILE_RENAMED")]), n % 4 + 1
    )
    device = F.concat(F.lit("HOST-"), (F.col("_u") % 20).cast("string"))
    if missing_devices:
        device = F.when(n % 25 == 0, "").otherwise(device)
    mapped = base.select(
        "id",
        "ts",
        _pick(kind, SOURCE_OF, "Defender").alias("source"),
        F.when(kind == "click", "BROWSER_VISIT")
        .when(kind == "view", file_type)
        .when(kind == "signup", F.when(n % 2 == 0, "4624").otherwise("4625"))
        .when(kind == "purchase", F.when(n % 2 == 0, "USB_CONNECTED").otherwise("USB_DISCONNECTED"))
        .otherwise("1116")
        .alias("event_type"),
        F.when(
            kind == "error",
            F.when(F.col("_v") >= 100, "CRITICAL").when(F.col("_v") >= 50, "HIGH").otherwise("WARNING"),
        )
        .when(kind == "signup", F.when(n % 10 == 0, "AUDIT_FAILURE").otherwise("AUDIT_SUCCESS"))
        .otherwise("INFO")
        .alias("severity"),
        F.when(kind.isin("purchase", "view"), "").otherwise(F.concat(F.lit("user"), F.col("_u").cast("string"))).alias(
            "user"
        ),
        device.alias("device"),
        F.when(
            kind.isin("view", "error"),
            F.concat(F.lit("C:/data/dir"), (n % 7).cast("string"), F.lit("/file"), n.cast("string"), F.lit(".docx")),
        )
        .when(kind == "click", F.concat(F.lit("http://example.test/p"), n.cast("string")))
        .otherwise("")
        .alias("file_path"),
        "metadata",
    )
    said = F.concat(F.col("source"), F.lit(" "), F.col("event_type"))
    return mapped.select(
        "id",
        "ts",
        "source",
        "event_type",
        F.when(F.col("file_path") != "", F.concat(said, F.lit(" "), F.col("file_path"))).otherwise(said).alias(
            "description"
        ),
        "severity",
        "user",
        "device",
        "file_path",
        "metadata",
        F.lit(None).cast("string").alias("event_hash"),
        F.lit(None).cast("string").alias("previous_hash"),
    )
