"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm import (
    attribution,
    backoff,
    binary_codes,
    conversations,
    mixing,
    multiset,
    neardup,
    packing,
    pii,
    quality,
    sharding,
    token_files,
    whitening,
)
from sleuthframe.llm.tables import keyed, read, ship_package
from sleuthframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Whole texts travel to Python in batches of this many rows and bytes.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> None:
    """Settings that the operators of this package rely on."""
    configure(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    ship_package(spark)


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_curriculum_mix(spark, d):
    docs = keyed(read(spark, d, "documents"))
    passes = mixing.in_training_order(mixing.curriculum(mixing.document_keys(docs)))
    return (
        passes.groupBy("_file", "_row")
        .agg(
            F.first("id").alias("doc_id"),
            F.first("size").alias("size"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.sum("taken").alias("taken"),
            F.min("position").alias("first_position"),
        )
        .drop("_file", "_row")
    )


@query
def op2_token_counts(spark, d):
    return attribution.token_counts(read(spark, d, "documents"))


@query
def op3_minmax_groups(spark, d):
    rows = neardup.text_rows(keyed(read(spark, d, "documents")))
    found = neardup.groups(rows, shingle=2, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query
def op4_token_files(spark, d):
    docs = read(spark, d, "documents")
    folder = token_files.write_tokens(docs)
    back = token_files.read_tokens(spark, folder)
    key = F.substring_index("key", "\t", 1)
    return back.select(
        F.when(key != "", key).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


@query
def op5_pii_spans(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pii.find(docs, F.col("text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[number(k) for k in pii.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


@query
def op6_backoff_scores(spark, d):
    docs = read(spark, d, "documents")
    found = backoff.score_documents(docs)
    return found.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query
def op7_multiset_fingerprints(spark, d):
    both = multiset.edited(read(spark, d, "documents"))
    own, nxt, new = F.col("lanes_signs"), F.col("next_lanes_signs"), F.col("edited_lanes_signs")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        multiset.as_text(F.col("lanes")).alias("fingerprint"),
        multiset.as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        multiset.likeness(F.col("lanes"), F.col("edited_lanes"), own, new).alias("near_edited"),
        multiset.likeness(F.col("lanes"), F.col("next_lanes"), own, nxt).alias("near_next"),
    )


@query
def op8_interleaved_shards(spark, d):
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    keys = keyed(read(spark, d, "documents")).select(
        "_file",
        "_row",
        F.col("_doc.doc_id").alias("id"),
        F.col("_doc.source").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.interleave(keys, carried=["size", "text_crc32"])
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_host_quality(spark, d):
    docs = read(spark, d, "documents")
    judged = quality.judge(quality.judged_rows(docs))
    return judged.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


@query
def op10_best_fit_packing(spark, d):
    return packing.pack(read(spark, d, "documents"))


@query
def op11_embedding_whitening(spark, d):
    return whitening.whiten(read(spark, d, "embeddings"))


@query
def op12_conversation_repair(spark, d):
    return conversations.repair_damaged(read(spark, d, "conversations"))


@query
def op13_embedding_duplicates(spark, d):
    return binary_codes.near_copies(read(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")
