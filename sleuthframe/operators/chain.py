"""SHA-256 hash chain over stored rows: row hashes, building, verification and labels.

A chain is a sequence by definition: the hash of a row needs the hash before it. Verification does not, because
the previous hash is stored, so it runs in id blocks. Building runs one chain per ``chain`` key; a table that is
too large for one linear chain is cut into segments of ``segment_rows`` ids whose tips form a chain of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import iso, row_hash, text
from sleuthframe.operators import hashtree
from sleuthframe.vocabulary import HASHED_UNVERIFIED, LEGACY, TAMPERED, VERIFIED

# Reasons of a failed row.
UNHASHED_INSERT = "unhashed event after chain start (possible inserted/removed record)"
HASH_MISMATCH = "event_hash does not match canonical data"
BROKEN_LINK = "previous_hash does not match preceding chained event (chain broken)"

BLOCK_ROWS = 100_000


def _is_hashed(c: str = "event_hash") -> Column:
    return text(c) != ""


def with_row_hash(events: DataFrame) -> DataFrame:
    """Recompute the hash of each row from its stored previous hash; no row needs another one."""
    return events.withColumn("recomputed_hash", row_hash(F.col("previous_hash")))


def segment(segment_rows: int) -> Column:
    """Chain key by id range: a chain never holds more than ``segment_rows`` rows. Verification needs the same key."""
    return F.floor((F.col("id") - 1) / F.lit(segment_rows)).cast("bigint")


def _fold() -> Callable[..., Column]:
    """Function of (chain, seed, head, tail) that walks the sorted rows of one partition and gives (event_hash, previous_hash).

    It keeps only the current hash between batches. Its value depends on the rows before, so it is not deterministic to
    Spark: no filter on its result may move below it. An inner function travels to the workers by value, so they need not
    have this package installed.
    """

    def fold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        chain, tip = None, ""
        for columns in batches:
            hashes, links = [], []
            for key, seed, head, tail in zip(*columns, strict=True):
                if key != chain:
                    chain, tip = key, seed
                links.append(tip)
                tip = hashlib.sha256((head + tip + tail).encode()).hexdigest()
                hashes.append(tip)
            yield pd.DataFrame({"event_hash": hashes, "previous_hash": links})

    return F.pandas_udf(fold, "event_hash string, previous_hash string").asNondeterministic()


def _folded(rows: DataFrame, seed: Column, head: Column, tail: Column) -> DataFrame:
    """``rows(chain, id, ...)`` with ``_h``, the hashes; the texts around the previous hash are made after the shuffle."""
    ordered = rows.repartition("chain").sortWithinPartitions("chain", "id")
    return ordered.withColumn("_h", _fold()(F.col("chain"), seed, head, tail))


def build_chain(
    events: DataFrame, chain: Column | None = None, tips: DataFrame | None = None, seed: Column | None = None
) -> DataFrame:
    """Chain rows in id order and fill both hash columns.

    ``chain`` is the chain key; without one all rows are one chain, as ``verify`` expects, and one task folds it.
    Name ``segment()`` for large tables. ``tips(chain, tip)`` continues stored chains; ``seed``, the
    tip before the first row of a chain or null, does so without a join where few chains go on. Rows are shuffled once, by
    chain. The row text is made on the JVM side around the place of the previous hash; Python gets these texts and gives
    the hashes, batch by batch, in constant memory, and the other columns stay on the JVM side.
    """
    keyed = events.drop("event_hash", "previous_hash").withColumn(
        "chain", (chain if chain is not None else F.lit("0")).cast("string")
    )
    rest = [c for c in keyed.columns if c not in ("chain", "id")]
    before = F.to_json(
        F.struct(*[text(c).alias(c) for c in ("description", "device", "event_type", "file_path", "metadata")])
    )
    after = F.to_json(
        F.struct(
            text("severity").alias("severity"),
            text("source").alias("source"),
            text(iso(F.col("ts"))).alias("timestamp"),
            text("user").alias("user"),
        )
    )
    if seed is None:
        seed = F.lit("")
    seeded = keyed.withColumn("_seed", seed) if tips is None else keyed.join(
        tips.select(F.col("chain").cast("string").alias("chain"), F.col("tip").alias("_seed")), "chain", "left"
    )
    head = F.concat(F.substr(before, F.lit(1), F.length(before) - 1), F.lit(',"previous_hash":"'))
    tail = F.concat(F.lit('",'), F.substr(after, F.lit(2)))
    return _folded(seeded, text("_seed"), head, tail).select("chain", "id", *rest, "_h.event_hash", "_h.previous_hash")


def chain_tips(chained: DataFrame, by: str = "chain") -> DataFrame:
    """Hash of the highest hashed id per chain."""
    return (
        chained.where(_is_hashed())
        .groupBy(by)
        .agg(F.max_by("event_hash", "id").alias("tip"), F.max("id").alias("tip_id"), F.count("*").alias("n"))
    )


def seal(tips: DataFrame) -> DataFrame:
    """One chain over segment tips, in segment order, so that a lost or reordered segment shows.

    Its input has one row per segment.
    """
    parts = tips.select(F.lit("seal").alias("chain"), F.col("chain").cast("bigint").alias("id"), "tip", "tip_id")
    tail = F.concat(F.lit('","tip":"'), "tip", F.lit('","tip_id":'), F.col("tip_id").cast("string"), F.lit("}"))
    return _folded(parts, F.lit(""), F.lit('{"previous_hash":"'), tail).select(
        F.col("id").alias("segment"), F.col("_h.event_hash").alias("seal_hash"), F.col("_h.previous_hash").alias("previous_seal")
    )


def broken_seals(rows: DataFrame, seals: DataFrame, by: str = "chain") -> DataFrame:
    """Segments whose rows don't lead to the stored seal, as (segment, missing).

    ``verify`` sees edits and gaps inside a segment; a deleted tail and a segment deleted whole show only here. A seal
    covers all segments before it, so the first of the result is where rows were lost or added.
    """
    now = seal(chain_tips(rows, by)).select("segment", F.col("seal_hash").alias("_now"))
    both = seals.select("segment", "seal_hash").join(now, "segment", "full")
    return both.where(~F.col("seal_hash").eqNullSafe(F.col("_now"))).select(
        "segment", F.col("_now").isNull().alias("missing")
    )


def verdicts(
    rows: DataFrame, chain: str | None = None, block_rows: int = BLOCK_ROWS, legacy_per_chain: bool = False
) -> DataFrame:
    """Per row: ``state`` (hashed, legacy or unhashed) and the reasons why it fails, empty when it does not.

    Rows without a hash are legacy before the first hashed row of the whole table, whatever their chain, or with
    ``legacy_per_chain`` before the first hashed row of their own chain, as where chains began at different times. Rows are checked in blocks of ``block_rows`` ids. Each block passes on only its last stored hash, so the link
    across blocks is settled on a table with one row per block.
    """
    key = ["_chain"]
    base = rows.withColumn("_chain", F.col(chain).cast("string") if chain else F.lit("")).withColumn(
        "_block", F.floor(F.col("id") / F.lit(block_rows)).cast("bigint")
    )
    base = base.select(
        *key, "_block", "id", _is_hashed().alias("_hashed"), "event_hash", "previous_hash",
        (row_hash(F.col("previous_hash")) != F.col("event_hash")).alias("_altered"),
    )
    blocks = base.groupBy(*key, "_block").agg(
        F.max_by(F.when(F.col("_hashed"), F.col("event_hash")), F.when(F.col("_hashed"), F.col("id"))).alias("_tip"),
        F.min(F.when(F.col("_hashed"), F.col("id"))).alias("_first"),
    )
    earlier = W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        *key,
        "_block",
        F.last("_tip", ignorenulls=True).over(earlier).alias("_carry"),
    )
    inside = W.partitionBy(*key, "_block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    linked = base.withColumn("_prev", F.last(F.when(F.col("_hashed"), F.col("event_hash")), ignorenulls=True).over(inside))
    # The rows lie by block already, so a merge moves only the one row per block. A broadcast would send the driver a table of
    # tens of MB, however few blocks there are, since a text is in the key.
    linked = linked.join(carried.hint("merge"), [*key, "_block"])
    expected = F.coalesce("_prev", "_carry", F.lit(""))
    if legacy_per_chain:
        started = F.coalesce("_prev", "_carry").isNotNull()
    else:
        began = blocks.agg(F.min("_first").alias("_began")).select("_began").scalar()
        started = F.coalesce(F.col("id") > began, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("_hashed") & started, UNHASHED_INSERT),
            F.when(F.col("_hashed") & F.col("_altered"), HASH_MISMATCH),
            F.when(F.col("_hashed") & (text("previous_hash") != expected), BROKEN_LINK),
        )
    )
    state = F.when(F.col("_hashed"), "hashed").when(started, "unhashed").otherwise("legacy")
    named = [F.col("_chain").alias(chain)] if chain else []
    return linked.select(*named, "id", state.alias("state"), reasons.alias("reasons"))


def verify(
    rows: DataFrame, chain: str | None = None, block_rows: int = BLOCK_ROWS, stored_tree: DataFrame | None = None,
    legacy_per_chain: bool = False,
) -> DataFrame:
    """One row: counts, verdict and status label. Failed ids are the rows of ``invalid_rows``.

    With the hash tree that was stored apart from the rows (``hashtree.tree``) lost tails and segments, which leave no broken
    link behind, count too: root_matches, changed_blocks, missing_events and added_events are added, and a chain is valid only
    if the roots agree. ``hashtree.differences`` names the ids.
    """
    return summarize(verdicts(rows, chain, block_rows, legacy_per_chain), rows, stored_tree)


def summarize(found: DataFrame, rows: DataFrame | None = None, stored_tree: DataFrame | None = None) -> DataFrame:
    """The row of ``verify`` from verdicts; ``rows`` are needed for the tree only."""
    found = found.agg(
        F.count("*").alias("checked_events"),
        F.count_if(F.col("state") == "hashed").alias("hashed_events"),
        F.count_if(F.col("state") == "legacy").alias("legacy_events"),
        F.count_if(F.size("reasons") > 0).alias("invalid_events"),
    )
    lost = []
    valid = F.col("invalid_events") == 0
    if stored_tree is not None:
        # Both sides are one row.
        lone = hashtree.summary(stored_tree, hashtree.tree(rows)).withColumn("_one", F.lit(1))
        found = found.withColumn("_one", F.lit(1)).join(lone, "_one")
        lost = ["root_matches", "changed_blocks", "missing_events", "added_events"]
        valid = valid & F.col("root_matches")
    return found.select(
        valid.alias("valid"),
        "checked_events",
        "hashed_events",
        "legacy_events",
        "invalid_events",
        F.when((F.col("checked_events") == 0) & (F.col("root_matches") if lost else F.lit(True)), "NO_EVENTS")
        .when(valid, "VALID")
        .otherwise("INVALID")
        .alias("status"),
        *lost,
    )


def invalid_rows(found: DataFrame) -> DataFrame:
    return found.where(F.size("reasons") > 0)


def label_column(verified: bool, invalid: Column | None = None) -> Column:
    """Integrity label of a row; ``invalid`` says whether verification flagged it."""
    if not verified:
        return F.when(~_is_hashed(), LEGACY).otherwise(HASHED_UNVERIFIED)
    return F.when(~_is_hashed(), LEGACY).when(invalid, TAMPERED).otherwise(VERIFIED)


def integrity_labels(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rows with their integrity label; without verdicts a hashed row stays unverified."""
    if found is None:
        return rows.withColumn("integrity", label_column(False))
    bad = invalid_rows(found).select("id", F.lit(True).alias("_bad"))
    return rows.join(bad, "id", "left").withColumn(
        "integrity", label_column(True, F.coalesce("_bad", F.lit(False)))
    ).drop("_bad")
