"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (session, documents, folder) and works on all that the stage before kept. All but the last return the
columns of the documents, also those that share a name with a column of an operator; values that a stage doesn't judge may be null.
An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sleuthframe.llm import mixing, neardup, packing, pii, quality
from sleuthframe.llm.queries import prepare
from sleuthframe.llm.tables import read, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go: null, empty and short texts fail the base rules.

    Repeated rows are judged alike; a null source is a host; very long texts are measured whole."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, a null id only where all are null.

    Of repeated rows one stays, the first by file and place; documents without words are no copies of each other."""
    prepare(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds; null texts stay null, rows stay as many as they are."""
    prepare(spark)
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; a source's last document is cut at its target.

    Null is the last source; documents without words are not taken; ties are broken by a hash, then by file and place."""
    prepare(spark)
    return mixing.mix(docs).select("_doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences; an empty or null text is one piece of its end token."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

# Near-duplicate groups, subword tokens and best-fit places are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
