import random

import pytest
from test_correlate import random_rows

from sleuthframe.operators.correlate import correlate
from sleuthframe.streaming import incidents

COLUMNS = ["incident_id", "event_count", "priority", "confidence_signals", "sources", "start_time", "end_time"]


def same_as_batch(spark, path, events):
    got = sorted(map(str, incidents.current(spark, path).select(*COLUMNS).collect()))
    assert got == sorted(map(str, correlate(events).incidents.select(*COLUMNS).collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_any_arrival_equals_one_correlation(spark, tmp_path, make_events, seed):
    rng = random.Random(seed)
    events = make_events(random_rows(rng, 90, 12_000, ["", "A", "B"] if seed else ["", "", "A", "B", "C"])).cache()
    path = str(tmp_path)
    parts = [[], [], []]
    for i in range(1, 91):
        rng.choice(parts).append(i)
    for n, ids in enumerate(parts):
        incidents.advance(events.where(events.id.isin(ids)), path, n)
        seen = [i for part in parts[: n + 1] for i in part]
        if n:
            same_as_batch(spark, path, events.where(events.id.isin(seen)))


def test_a_late_row_joins_incidents(spark, tmp_path, make_events):
    browse = {"source": "Browser", "event_type": "BROWSER_VISIT", "user": "alice"}
    rows = [{"at": t, "device": d, **browse} for d, t in (("A", 0), ("A", 5), ("B", 10), ("B", 15))]
    rows += [{"at": 50_000 + t, "device": "C"} for t in (0, 1)] + [{"at": 7, **browse}, {"at": 90_000, "device": "D"}]
    events, path = make_events(rows), str(tmp_path)
    for n, (low, high) in enumerate(((1, 6), (7, 8))):
        for _ in range(2):  # the second run of a micro-batch replaces the first one
            incidents.advance(events.where(f"id BETWEEN {low} AND {high}"), path, n)
    found = {r["event_count"]: r for r in incidents.current(spark, path).collect()}
    assert set(found) == {2, 5}
    assert found[5]["revision"] == 2 and len(found[5]["replaces"]) == 2
    assert found[2]["revision"] == 1 and found[2]["replaces"] == []
    log = [(r["batch"], r["what"]) for r in incidents.changes(spark, path).collect()]
    assert sorted(log) == [(0, "found")] * 3 + [(1, "found"), (1, "retracted"), (1, "retracted")]


def test_an_unfinished_micro_batch_is_not_seen(spark, tmp_path, make_events):
    events, path = make_events([{"at": t, "device": "A"} for t in (0, 1, 2, 3)]), str(tmp_path)
    incidents.advance(events.where("id <= 2"), path, 0)
    incidents.advance(events.where("id > 2"), path, 1)
    assert [r["event_count"] for r in incidents.current(spark, path).collect()] == [4]
    # As if the process had died before the commit of the second one.
    commits = spark.read.parquet(f"{path}/commits").where("batch = 0").drop("batch").collect()
    other = f"{path}-copy"
    for name in ("groups", "dropped", "incidents"):
        spark.read.parquet(f"{path}/{name}").write.partitionBy("batch").parquet(f"{other}/{name}")
    spark.createDataFrame(commits, "at timestamp").write.parquet(f"{other}/commits/batch=0")
    assert [r["event_count"] for r in incidents.current(spark, other).collect()] == [2]


def test_tables_of_a_micro_batch_do_not_stay(spark, make_events, tmp_path):
    import os

    from sleuthframe.session import checkpoint_root
    from sleuthframe.streaming import incidents, jobs

    events = make_events([{"at": i * 40, "device": "D" if i % 3 else "", "user": "u"} for i in range(12)])
    events.write.parquet(f"{tmp_path}/in")
    at = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(at))
    stream = jobs.watch(spark, f"{tmp_path}/in", events.schema)
    incidents.live_incidents(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert incidents.current(spark, f"{tmp_path}/out").count() == 1
    assert not [x for x in set(os.listdir(at)) - before if x.startswith("table-")]
