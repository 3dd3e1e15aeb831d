import random

import pytest
from brute import incidents as brute
from pyspark.sql import functions as F

from sleuthframe.operators import correlate as correlation
from sleuthframe.operators.correlate import correlate, device_sessions


def run(events, **kw):
    c = correlate(events, **kw)
    out = {}
    for r in c.incidents.collect():
        out[r["incident_id"]] = [[], set(), set(r["confidence_signals"]), r["priority"], r["event_count"]]
    for r in c.members.collect():
        out[r["incident_id"]][0].append(r["event_id"])
    for r in c.reasons.collect():
        out[r["incident_id"]][1].add(r["reason"])
    return out


def check(make_events, rows, window=300, **kw):
    events = make_events(rows)
    want = brute([r.asDict() for r in events.collect()], window)
    got = run(events, window_seconds=window, **kw)
    assert set(got) == set(want)
    for key, (ids, reasons, signals, level) in want.items():
        assert sorted(got[key][0]) == ids
        assert got[key][1] == reasons
        assert got[key][2] == signals
        assert got[key][3] == level
        assert got[key][4] == len(ids)
    return got


def test_window_edges(make_events):
    rows = [{"at": 0, "device": "A"}, {"at": 200, "device": "A"}]
    assert len(check(make_events, rows, 300)) == 1
    assert len(check(make_events, rows, 100)) == 0
    assert len(check(make_events, [{"at": 0, "device": "A"}, {"at": 300, "device": "A"}])) == 1
    assert len(check(make_events, [{"at": 0, "device": "A"}, {"at_us": 300_000_001, "device": "A"}])) == 0
    assert len(check(make_events, [{"at": 0, "device": "A"}, {"at": 0, "device": "A"}, {"at": 1, "device": "A"}], 0)) == 1


def test_bridge_and_veto(make_events):
    browse = {"source": "Browser", "event_type": "BROWSER_VISIT", "user": "alice"}
    got = check(
        make_events,
        [{"at": 0, "device": "A", **browse}, {"at": 10, **browse}, {"at": 20, "device": "B", **browse}],
    )
    assert [len(v[0]) for v in got.values()] == [3]
    assert check(make_events, [{"at": 0, "device": "A"}, {"at": 10, "device": "B"}]) == {}
    assert check(make_events, [{"at": 0, "source": "Browser"}, {"at": 0, "source": "Browser"}]) == {}


def test_transitive_and_priority(make_events):
    rows = [{"at": t, "device": "A"} for t in (0, 200, 400)]
    assert [v[4] for v in check(make_events, rows).values()] == [3]
    pairs = (
        ({"source": "Defender", "severity": "CRITICAL"}, {}),
        ({"source": "Defender"}, {"source": "Defender"}),
        ({"source": "USB"}, {}),
        ({"source": "Browser"}, {}),
        ({"source": "Browser", "severity": "CRITICAL"}, {}),
    )
    rows = [{"at": i, "device": f"D{k}", **p} for k, pair in enumerate(pairs) for i, p in enumerate(pair)]
    got = {min(v[0]): v[3] for v in check(make_events, rows).values()}
    assert [got[k] for k in sorted(got)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH"]


def random_rows(rng, n, span, devices):
    users = ["", "", "u1", "u2", "u3"]
    paths = ["", "", "C:/d1/a.txt", "c:\\D1\\A.txt", "C:/d1/b.txt", "C:/d2/c.txt", "plain.txt", "PLAIN.txt/", "/"]
    rows = []
    for _ in range(n):
        rows.append(
            {
                "at_us": rng.choice([rng.randrange(span * 1_000_000), rng.randrange(span) * 1_000_000]),
                "source": rng.choice(["USB", "FileSystem", "Browser", "Defender", "Windows", "Other"]),
                "severity": rng.choice(["INFO", "WARNING", "HIGH", "CRITICAL", "odd"]),
                "user": rng.choice(users),
                "device": rng.choice(devices),
                "file_path": rng.choice(paths),
            }
        )
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_mixed(make_events, seed):
    rng = random.Random(seed)
    devices = [["A", "B", "C"], ["", "A", "B"], [""], ["", "", "", "A", "B", "C", "D"]][seed]
    check(make_events, random_rows(rng, 120, 30_000, devices))


def test_scopes_stay_apart(make_events):
    import pyspark.sql.functions as F

    rng = random.Random(99)
    base = make_events(random_rows(rng, 30, 6000, ["", "A", "B"]))
    both = base.withColumn("case_id", F.explode(F.array(F.lit(1), F.lit(2)))).where("case_id = 1 OR id % 2 = 0")
    c = correlate(both, by=["case_id"])
    got = {(r["case_id"], r["incident_id"]) for r in c.incidents.collect()}
    want = set()
    for case in (1, 2):
        rows = [r.asDict() for r in both.where(f"case_id = {case}").collect()]
        want |= {(case, k) for k in brute(rows)}
    assert got == want


def test_parts_of_a_large_incident(make_events):
    events = make_events([{"at": i, "device": "A"} for i in range(50)])
    c = correlate(events, ids_per_part=10)
    assert c.incidents.count() == 1
    rows = c.parts.collect()
    assert len(rows) == 5
    assert sorted(i for r in rows for i in r["event_ids"]) == list(range(1, 51))


def test_incident_ids_do_not_depend_on_the_part_size(make_events):
    rng = random.Random(5)
    rows = random_rows(rng, 60, 9000, ["", "A", "B", "C"]) + [{"at": 20_000 + i, "device": "A"} for i in range(130)]
    got = check(make_events, rows, ids_per_part=4)
    assert max(n for *_, n in got.values()) >= 130
    assert min(n for *_, n in got.values()) <= 4


def test_rows_without_ids(make_events):
    rows = [{"at": t, "device": d} for d in ("A", "B") for t in (0, 1)] + [{"at": 9000, "device": "A"}]
    rows += [{"at": 20_000, "source": "Browser", "event_type": "V", "description": d} for d in ("x", "y")]
    bare = make_events(rows).withColumn("id", F.lit(None).cast("bigint"))
    got = correlate(bare, min_group_size=1)
    ids = [r["incident_id"] for r in got.incidents.collect()]
    assert len(ids) == len(set(ids)) == 5
    assert len({r["fingerprint"] for r in got.incidents.collect()}) == 5
    members = got.members.collect()
    assert len(members) == 7 and all(r["event_id"] is None for r in members)
    again = {r["incident_id"] for r in correlate(bare.repartition(3), min_group_size=1).incidents.collect()}
    assert again == set(ids)


def test_groups_can_be_compacted_again(make_events):
    rng = random.Random(8)
    events = make_events(random_rows(rng, 80, 6000, ["", "A", "B"]) + [{"at": 5, "device": "A"}] * 20)
    rows = correlation._with_cell(correlation.features(events), 300_000_000)
    whole = correlation.compact(rows, [])
    halves = correlation.compact(rows.where("id % 2 = 0"), []).unionByName(correlation.compact(rows.where("id % 2 = 1"), []))
    assert sorted(map(str, correlation.recompact(halves, []).collect())) == sorted(map(str, whole.collect()))
    want = {r["incident_id"] for r in correlate(events).incidents.collect()}
    assert {r["incident_id"] for r in correlation.correlate_groups(halves).incidents.collect()} == want


def test_sessions(make_events):
    rows = [{"at": t, "device": d} for d, t in (("A", 0), ("A", 300), ("A", 601), ("B", 0))]
    got = {(r["device"], r["n_events"]) for r in device_sessions(make_events(rows)).collect()}
    assert got == {("A", 2), ("A", 1), ("B", 1)}


def test_bad_window(make_events):
    with pytest.raises(ValueError):
        correlate(make_events([{"at": 0}]), window_seconds=-1)


def test_signals_are_found_without_the_texts_of_reasons(make_events):
    events = make_events([{"at": i * 40, "device": "D" if i % 3 else "", "user": "u", "file_path": f"/a/{i}"} for i in range(12)])
    found = correlate(events)
    spark = events.sparkSession
    kept = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", 10**8)
    try:
        plan = found.incidents._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", kept)
    assert "same user: " not in plan and "same directory" not in plan
    named = {s for r in found.incidents.collect() for s in r["confidence_signals"]}
    assert named == {r["signal"] for r in found.reasons.collect()}
