import hashlib
import json

import pyspark.sql.functions as F
import pytest

from sleuthframe.operators import chain

FIELDS = ["source", "event_type", "description", "severity", "user", "device", "file_path", "metadata"]


def plain_hash(row, previous):
    payload = {c: row[c] or "" for c in FIELDS}
    payload["timestamp"] = row["ts"].isoformat() if row["ts"] else ""
    payload["previous_hash"] = previous or ""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(make_events):
    extra = [{"at": i, "description": f'd"{i}\\ é\n', "metadata": json.dumps({"i": i}), "user": None if i % 2 else "u"} for i in range(9)]
    return make_events([*extra, {"at_us": 1500, "description": "micro"}])


def test_linear_chain_and_segments(rows):
    want, previous = {}, ""
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want[r["id"]] = (plain_hash(r, previous), previous)
        previous = want[r["id"]][0]
    built = chain.build_chain(rows)
    assert {r["id"]: (r["event_hash"], r["previous_hash"]) for r in built.collect()} == want
    parts = chain.build_chain(rows, chain.segment(4))
    tips = {r["chain"]: r["tip_id"] for r in chain.chain_tips(parts).collect()}
    assert tips == {"0": 4, "1": 8, "2": 10}
    seals = chain.seal(chain.chain_tips(parts)).orderBy("segment").collect()
    assert [s["previous_seal"] for s in seals][1:] == [s["seal_hash"] for s in seals][:-1]


def test_second_batch_continues(rows):
    whole = {r["id"]: r["event_hash"] for r in chain.build_chain(rows).collect()}
    first = chain.build_chain(rows.where("id <= 6"))
    second = chain.build_chain(rows.where("id > 6"), tips=chain.chain_tips(first))
    assert {r["id"]: r["event_hash"] for r in second.collect()} == {k: v for k, v in whole.items() if k > 6}


def flagged(rows, block):
    return {r["id"]: r["reasons"] for r in chain.invalid_rows(chain.verdicts(rows, block_rows=block)).collect()}


@pytest.mark.parametrize("block", [3, 1000])
def test_tampering(rows, block):
    built = chain.build_chain(rows).cache()
    assert flagged(built, block) == {}
    edit = lambda c, v: built.withColumn(c, F.when(F.col("id") == 4, F.lit(v)).otherwise(F.col(c)))
    for c in ("description", "file_path", "metadata", "severity"):
        assert flagged(edit(c, "other"), block) == {4: [chain.HASH_MISMATCH]}
    assert flagged(edit("event_hash", "ff"), block) == {4: [chain.HASH_MISMATCH], 5: [chain.BROKEN_LINK]}
    assert flagged(edit("previous_hash", "ff"), block) == {4: [chain.HASH_MISMATCH, chain.BROKEN_LINK]}
    assert flagged(built.where("id <> 4"), block) == {5: [chain.BROKEN_LINK]}
    bare = built.withColumn("event_hash", F.when(F.col("id") != 4, F.col("event_hash")))
    assert flagged(bare, block) == {4: [chain.UNHASHED_INSERT], 5: [chain.BROKEN_LINK]}
    later = chain.build_chain(rows.where("id > 3"))
    old = rows.where("id <= 3").withColumn("chain", F.lit("0"))
    both = later.unionByName(old)
    v = chain.verify(both, block_rows=block).first()
    assert (v["valid"], v["checked_events"], v["hashed_events"], v["legacy_events"], v["status"]) == (True, 10, 7, 3, "VALID")
    labels = chain.integrity_labels(edit("severity", "x"), chain.verdicts(edit("severity", "x")))
    assert {r["id"]: r["integrity"] for r in labels.collect()}[4] == "TAMPERED"


def test_no_rows(rows):
    v = chain.verify(chain.build_chain(rows.where("id < 0"))).first()
    assert (v["valid"], v["status"]) == (True, "NO_EVENTS")


def test_seals_show_lost_rows(make_events):
    rows = make_events([{"at": i} for i in range(12)])
    whole = chain.build_chain(rows, chain.segment(4))
    seals = chain.seal(chain.chain_tips(whole))
    lost = lambda kept: sorted((r["segment"], r["missing"]) for r in chain.broken_seals(kept, seals).collect())
    assert lost(whole) == []
    assert lost(whole.where("id <> 8")) == [(1, False), (2, False)]
    assert lost(whole.where("id > 4")) == [(0, True), (1, False), (2, False)]
    assert lost(whole.where("id <= 8")) == [(2, True)]


def test_default_chain_verifies_past_a_million_ids(make_events):
    rows = make_events([{"at": i, "id": 999_997 + i} for i in range(6)])
    assert chain.verify(chain.build_chain(rows)).first()["status"] == "VALID"


def test_stripped_start_of_a_later_segment_is_no_legacy(make_events):
    rows = chain.build_chain(make_events([{"at": i} for i in range(8)]), chain.segment(4))
    gone = F.col("id").isin(5, 6)
    cut = rows.withColumn("event_hash", F.when(~gone, F.col("event_hash")))
    states = {r["id"]: r["state"] for r in chain.verdicts(cut, "chain").collect()}
    assert states[5] == states[6] == "unhashed"


@pytest.mark.parametrize("block", [3, 1000])
def test_legacy_rows_of_each_chain(make_events, block):
    rows = chain.build_chain(make_events([{"at": i} for i in range(8)]), chain.segment(4))
    gone = F.col("id").isin(5, 6, 8)
    cut = rows.withColumn("event_hash", F.when(~gone, F.col("event_hash")))
    found = {r["id"]: (r["state"], len(r["reasons"])) for r in chain.verdicts(cut, "chain", block, legacy_per_chain=True).collect()}
    assert {i: found[i] for i in (5, 6, 7, 8)} == {5: ("legacy", 0), 6: ("legacy", 0), 7: ("hashed", 1), 8: ("unhashed", 1)}
    v = chain.verify(cut, "chain", block, legacy_per_chain=True).first()
    assert (v["hashed_events"], v["legacy_events"], v["invalid_events"]) == (5, 2, 2)


def test_chain_is_built_with_one_shuffle_and_no_join(rows):
    keyed = chain.build_chain(rows, chain.segment(4))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    whole = {r["id"]: r["event_hash"] for r in keyed.collect()}
    # A filter on the built rows must not reach the rows that are hashed.
    left = {r["id"]: r["event_hash"] for r in keyed.where("id % 3 = 0 AND severity = 'INFO'").collect()}
    assert left == {k: v for k, v in whole.items() if k % 3 == 0}
    assert keyed.where("id > 5").count() == len(whole) - 5


@pytest.mark.parametrize("key", [None, "chain"])
def test_blocks_are_linked_by_a_merge(spark, rows, key):
    """A broadcast with a text as its key sends the driver a table of tens of MB, however few rows it has."""
    found = chain.verdicts(chain.build_chain(rows, chain.segment(4) if key else None), key, block_rows=3)
    length = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    try:
        assert len(chain.invalid_rows(found).collect()) == 0
        assert len(found.collect()) == rows.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", length)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_tables_are_stored_compressed(spark, data):
    from sleuthframe.plans import derived
    from sleuthframe.session import cut_lineage, stored

    rows = derived.stored_chain(spark, data, tampered=True)
    kept = stored(rows)
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.schema.simpleString() == rows.schema.simpleString()
    want = cut_lineage(rows)
    assert kept.count() == want.count() and kept.exceptAll(want).isEmpty()
