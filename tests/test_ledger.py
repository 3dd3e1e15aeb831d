import json

import pytest

from sleuthframe.operators import chain
from sleuthframe.streaming import ledger


def raw(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in rows], "batch_pos bigint, raw string")


def record(i, **more):
    return {"timestamp": f"2026-01-01T10:00:{i:02d}", "source": "USB", "event_type": "USB_X", "description": f"d{i}", **more}


FIRST = [(0, record(5)), (1, record(2)), (2, record(2)), (3, "no json"), (4, record(3, source="")), (5, record(4, description=" "))]
SECOND = [(6, record(1, source="Browser")), (7, record(9)), (8, record(7, timestamp="soon"))]


def state(spark, path):
    rows = ledger.events(spark, path).collect()
    stats = {r["source"]: tuple(r)[1:6] for r in ledger.statistics(spark, path).collect()}
    return sorted((r["id"], r["description"], r["event_hash"]) for r in rows), stats


def test_micro_batches_continue_ids_and_chain(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for n, rows in enumerate((FIRST, SECOND, [])):
        ledger.ingest_batch(raw(spark, rows), path, n, segment_rows=3)
    rows, stats = state(spark, path)
    assert [(i, d) for i, d, _ in rows] == [(1, "d2"), (2, "d5"), (3, "d1"), (4, "d9")]
    # received, inserted, duplicates, skipped, errors
    assert stats == {"USB": (6, 3, 1, 1, 1), "Browser": (1, 1, 0, 0, 0), "": (2, 0, 0, 0, 2)}
    stored = ledger.events(spark, path)
    assert {r["chain"] for r in stored.collect()} == {"0", "1"}
    assert chain.verify(stored, "chain").first()["status"] == "VALID"
    reasons = {r["batch_pos"]: (r["stage"], r["batch"]) for r in ledger.committed(spark, path, "rejects").collect()}
    assert reasons == {3: ("normalize", 0), 4: ("normalize", 0), 5: ("validation", 0), 8: ("normalize", 1)}


@pytest.mark.parametrize("dies_before", ["rejects", "commits"])
def test_a_killed_micro_batch_leaves_nothing(spark, tmp_path, monkeypatch, dies_before):
    path, whole = str(tmp_path / "killed"), str(tmp_path / "whole")
    for at in (path, whole):
        ledger.ingest_batch(raw(spark, FIRST), at, 0, segment_rows=3)
    before = state(spark, path)
    save = ledger._save

    def dying(df, target, batch):
        if target.endswith(dies_before):
            raise RuntimeError("killed")
        save(df, target, batch)

    monkeypatch.setattr(ledger, "_save", dying)
    with pytest.raises(RuntimeError):
        ledger.ingest_batch(raw(spark, SECOND), path, 1, segment_rows=3)
    assert state(spark, path) == before
    monkeypatch.setattr(ledger, "_save", save)
    for at in (path, whole):
        ledger.ingest_batch(raw(spark, SECOND), at, 1, segment_rows=3)
    assert state(spark, path) == state(spark, whole)


def test_a_micro_batch_joins_only_its_counts_by_task(spark, tmp_path, monkeypatch):
    """A join with a text as its key sends the driver a table of tens of MB, however few rows it has."""
    path, plans = str(tmp_path / "ledger"), {}
    ledger.ingest_batch(raw(spark, FIRST), path, 0, segment_rows=3)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cut, save = ledger.cut_lineage, ledger._save
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: (plans.setdefault(f"cut {len(plans)}", plan(df)), cut(df))[1])
    monkeypatch.setattr(ledger, "_save", lambda df, at, n: (plans.setdefault(at.rpartition("/")[2], plan(df)), save(df, at, n)))
    length = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    try:
        ledger.ingest_batch(raw(spark, SECOND), path, 1, segment_rows=3)
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", length)
    joins = [line for text in plans.values() for line in text.splitlines() if "Join " in line]
    assert len(plans) == 7 and len(joins) == 1 and "(_p#" in joins[0]
    assert chain.verify(ledger.events(spark, path), "chain").first()["status"] == "VALID"


def test_tables_of_a_micro_batch_do_not_stay(spark):
    import os

    from sleuthframe.session import checkpoint_root, passing_tables, stored

    at = checkpoint_root(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(at) if x.startswith("table-")}
    before = tables()
    with passing_tables(spark):
        assert stored(spark.range(5)).count() == 5
        assert len(tables() - before) == 1
    assert tables() == before
