"""Session settings and the checkpoint folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # The driver keeps the text of every executed plan, also each time a plan is adapted; whole plans would fill its memory.
    "spark.sql.maxPlanStringLength": "4096",
    # Sets of a few names per group stay in the hash aggregate for this many groups before it sorts.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # Newest-N rows per group are cut on the map side up to this N.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "sleuthframe", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Create a session; leave ``master`` unset under spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the call site of every column expression costs more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="sleuthframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so later stages never recompute it."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


# Tables that ``stored`` wrote inside of ``passing_tables``.
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back.

    For tables as long as the events: a checkpoint keeps whole rows uncompressed, a table keeps columns apart and compressed,
    and who needs few of them reads few. The table stays until its folder is cleared, or to the end of ``passing_tables``.
    """
    at = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(at)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove what ``stored`` writes in this block at its end, as a micro-batch does when its results are written."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        made = _PASSING.get()
        _PASSING.reset(token)
        for at in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
