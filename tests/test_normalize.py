import datetime as dt
import json

import pyspark.sql.functions as F

from sleuthframe.operators.normalize import deduplicate, ingest_stats, next_ids, normalize, rejects, staged

T = "2026-03-01T10:00:00"


def raw(spark, *records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "batch_pos bigint, raw string")


def test_aliases_times_and_metadata(spark):
    base = {"source": "S", "type": "T", "message": "m"}
    got = normalize(
        raw(
            spark,
            {**base, "ts": T, "level": "HIGH", "account": "a", "computer": "c", "url": "u", "title": "lost"},
            {**base, "time": "2026-03-01 10:00:00.25", "timestamp": ""},
            {**base, "time": "2026/03/01 10:00:00"},
            {**base, "time": "03/01/2026 10:00:00"},
            {**base, "time": "2026-03-01"},
            {**base, "time": 1772359200},
            {**base, "time": "2026-03-01T12:00:00+02:00"},
            {**base, "time": T, "metadata": {"b": 1, "a": [1, {"x": None}]}, "z": True, "y": "", "x": None},
            {**base, "time": T, "metadata": "note", "n": 1.5},
        )
    ).collect()
    got = {r["batch_pos"]: r for r in got}
    ten = dt.datetime(2026, 3, 1, 10)
    assert [got[i]["ts"] for i in (0, 2, 3, 5, 6)] == [ten] * 5
    assert got[1]["ts"] == dt.datetime(2026, 3, 1, 10, 0, 0, 250000)
    assert got[4]["ts"] == dt.datetime(2026, 3, 1)
    first = got[0]
    assert [first[c] for c in ("severity", "user", "device", "file_path", "description", "metadata")] == [
        "HIGH", "a", "c", "u", "m", "",
    ]
    assert got[1]["severity"] == "INFO"
    assert got[7]["metadata"] == '{"a":[1,{"x":null}],"b":1,"z":true}'
    assert got[8]["metadata"] == '{"metadata":"note","n":1.5}'


def test_rejects(spark):
    ok = {"source": "S", "type": "T", "message": "m", "time": T}
    bad = [
        {**ok, "source": ""},
        {**ok, "type": None},
        {k: v for k, v in ok.items() if k != "time"},
        {**ok, "time": "soon"},
        {**ok, "time": True},
        {**ok, "message": " \t\n"},
        "not json",
    ]
    df = raw(spark, ok, *bad)
    found = {r["batch_pos"]: (r["stage"], r["reason"]) for r in rejects(df).collect()}
    assert found == {
        1: ("normalize", "source is required"),
        2: ("normalize", "event_type is required"),
        3: ("normalize", "timestamp is missing"),
        4: ("normalize", "timestamp is not recognized"),
        5: ("normalize", "timestamp is not recognized"),
        6: ("validation", "description is required but empty"),
        7: ("normalize", "record is not a JSON object"),
    }
    s = ingest_stats(df).first()
    assert (s["received"], s["normalized"], s["inserted"], s["skipped"], s["errors"]) == (8, 2, 1, 1, 6)
    assert normalize(raw(spark, bad[0]), source="Given").first()["source"] == "Given"


def test_first_copy_wins_and_ids_follow_time(spark):
    ok = {"source": "S", "type": "T", "message": "m"}
    df = normalize(
        raw(spark, {**ok, "time": "2026-03-02"}, {**ok, "time": T, "level": "LOW"}, {**ok, "time": T, "level": "HIGH"})
    )
    kept = deduplicate(df).collect()
    assert sorted((r["batch_pos"], r["severity"]) for r in kept) == [(0, "INFO"), (1, "LOW")]
    ids = next_ids(df, 10).collect()
    assert [(r["id"], r["severity"]) for r in sorted(ids, key=lambda r: r["id"])] == [(11, "LOW"), (12, "HIGH"), (13, "INFO")]


def test_iso_without_separators(spark):
    from pyspark.sql import functions as F

    from sleuthframe.functions.timestamps import strict

    cases = {
        "2024-01-01T02:00:00+0200": "2024-01-01 00:00:00", "2024-01-01T02:00:00+02": "2024-01-01 00:00:00",
        "20240101T101010": "2024-01-01 10:10:10", "20240101T121010+0200": "2024-01-01 10:10:10",
        "2024-01-01": "2024-01-01 00:00:00", "20240101": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", strict(F.col("v")).cast("string").alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


def test_times_are_parsed_once(spark):
    df = raw(spark, {"source": "S", "type": "T", "message": "m", "time": T})
    kept = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", 10**8)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    try:
        assert plan(normalize(df)).count("M/d/y H:m:s") == 1
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", kept)


def test_zones_and_basic_forms_are_still_rewritten(spark):
    base = {"source": "S", "type": "T", "message": "m"}
    forms = ["20260301T100000", "2026-03-01T12:00:00+0200", "2026-03-01 12:00:00.5 +02", " 20260301 120000+0200", "20260301", "2026-03-01T10:00:00-"]
    got = {r["batch_pos"]: r["ts"] for r in normalize(raw(spark, *[{**base, "time": t} for t in forms])).collect()}
    ten = dt.datetime(2026, 3, 1, 10)
    assert got == {0: ten, 1: ten, 2: ten.replace(microsecond=500000), 3: ten}


def test_rows_to_number_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    events = normalize(raw(spark, *[{"source": "S", "type": "T", "message": f"m{i}", "time": 1772359200 - i} for i in range(50)]))
    events = events.withColumn("description", F.udf(one, "string")("description"))
    ids = {r["description"]: r["id"] for r in next_ids(events, 10).collect()}
    assert ids == {f"m{i}": 60 - i for i in range(50)} and made.value == 50
