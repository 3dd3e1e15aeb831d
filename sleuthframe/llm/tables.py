"""Helpers shared by the operators of this package: reads, written intermediate tables, global order and running totals."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sleuthframe.session import checkpoint_root, cut_lineage

# A word, as all contracts of this package define it.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]"

# monotonically_increasing_id keeps the row number of a partition in its lower 33 bits.
ROW_BITS = (1 << 33) - 1


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of a given table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the workers this library, once per session, through the shared folder.

    They then import it, and keep what its modules remember (vocabularies, hashes of words) from task to task.
    """
    context = spark.sparkContext
    if getattr(context, "_library_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, str(path.relative_to(top.parent)))
    folder = shared_folder(spark, "library")
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{top.name}.zip") as f:
        f.write(whole.getvalue())
    context.addPyFile(f"{folder}/{top.name}.zip")
    context._library_shipped = True


def file_system(folder: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def settle(df: DataFrame) -> DataFrame:
    """Write a narrow table to the shared checkpoint folder, so that a lost executor never recomputes it."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that the cluster names."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table as compressed Parquet to the shared folder and read it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """(_doc, _file, _row): each row as one struct, with the file and the place in it as a key that every scan repeats.

    A frame that isn't a plain scan of files is stored first. All columns travel inside the struct, so names that the
    operators use can't clash with columns of the table.
    """
    try:
        place = df.metadataColumn("_metadata")
        return df.select(
            F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_doc"),
            F.xxhash64(place.getField("file_path")).alias("_file"),
            place.getField("row_index").alias("_row"),
        )
    except AnalysisException:
        return keyed(stored(df, "rows"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list, totals: dict[str, str] | None = None, position: str = "_pos") -> DataFrame:
    """Add the 0-based place of each row in the order of the whole table, and running totals before each row.

    The table is dealt out by ranges of the order and settled. Counts and sums of whole partitions, one row per
    partition, then shift the numbers found inside each partition; no task sees more than its own range. Rows that are
    equal in ``order`` get different places. ``totals`` maps new column names to columns that are summed.
    """
    totals = totals or {}
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    )
    parts = placed.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in totals.items()]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_base_{name}") for name in totals],
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for name, c in totals.items():
        placed = placed.withColumn(f"_run_{name}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    # One row per partition of this job: its size is bound by the number of partitions, not by the rows.
    joined = placed.join(F.broadcast(shifts), "_part")
    return joined.select(
        *df.columns,
        (F.col("_base") + F.col("_at")).alias(position),
        *[(F.col(f"_base_{name}") + F.col(f"_run_{name}")).alias(name) for name in totals],
    )
