import datetime as dt

from sleuthframe.operators.cursors import read_by_record_number, read_by_visit

C = "channel string, record_number bigint"


def step(spark, numbers, cursor, backfill=100):
    records = spark.createDataFrame([("c", n) for n in numbers], C)
    cursors = spark.createDataFrame([("c", cursor)] if cursor is not None else [], C)
    admitted, moved = read_by_record_number(records, cursors, backfill)
    return sorted(r["record_number"] for r in admitted.collect()), moved.first()["record_number"]


def test_record_numbers(spark):
    assert step(spark, [10, 11, 12], None) == ([10, 11, 12], 12)
    assert step(spark, [10, 11, 12, 13], 12) == ([13], 13)
    assert step(spark, [10, 11, 12], 12) == ([], 12)
    assert step(spark, [1, 2], 100) == ([1, 2], 2)
    assert step(spark, [5, 6], None, 0) == ([], 6)
    assert step(spark, [5, 6, 7], None, 2) == ([6, 7], 7)


def test_visit_boundary(spark):
    t = [None] + [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    v_schema, c_schema, b_schema = "profile_key string, ts timestamp_ntz, url string", "profile_key string, last_visit timestamp_ntz", "profile_key string, url_key string"
    cursors, boundary = spark.createDataFrame([], c_schema), spark.createDataFrame([], b_schema)
    counts = []
    for poll in ([("a", 2), ("b", 1)], [("a", 2), ("b", 1)], [("a", 2), ("c", 2)], [("a", 3)]):
        visits = spark.createDataFrame([("p", t[i], u) for u, i in poll], v_schema)
        admitted, moved, keys = read_by_visit(visits, cursors, boundary)
        counts.append(admitted.count())
        cursors = spark.createDataFrame(moved.collect(), c_schema)
        boundary = spark.createDataFrame(keys.collect(), b_schema)
    assert counts == [2, 0, 1, 1]
    assert cursors.first()["last_visit"] == t[3] and boundary.count() == 1
