import datetime as dt
import itertools

import pytest

from sleuthframe.streaming import jobs, keyed

RECORDS = "channel string, record_number bigint, ts timestamp_ntz, poll int, note string"
VISITS = "profile_key string, ts timestamp_ntz, url string, poll int"
T0 = dt.datetime(2026, 1, 1)


def deliver(spark, tmp_path, schema, polls, make):
    """What each delivery of rows adds to the result; the query starts anew each time."""
    at, seen, out = str(tmp_path), [], []
    for rows in polls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = make(jobs.watch(spark, f"{at}/in", spark.createDataFrame([], schema).schema))
        jobs.append_rows(stream, f"{at}/out", f"{at}/state", one_batch=True).awaitTermination()
        now = sorted(tuple(r) for r in spark.read.parquet(f"{at}/out").collect())
        new = list(now)
        for r in seen:
            new.remove(r)
        out.append(new)
        seen = now
    return out


def test_stretches():
    assert keyed.merge_stretches({}, [(1, 3), (5, 6)], 1) == {1: 3, 5: 6}
    assert keyed.merge_stretches({1: 3, 9: 12}, [(4, 8)], 1) == {1: 12}
    assert keyed.merge_stretches({1: 3}, [(4, 8)], 0) == {1: 3, 4: 8}
    assert keyed.merge_stretches({1: 9}, [(3, 4)], 0) == {1: 9}


def test_records(spark, tmp_path):
    def rows(numbers, poll=0, channel="a", day=0):
        return [(channel, n, T0 + dt.timedelta(days=day, seconds=n), poll, f"{channel}{n}") for n in numbers]

    polls = [
        [*rows(range(10, 21)), *rows(range(1, 6), channel="b"), (None, 1, T0, 0, "x"), ("a", None, T0, 0, "x")],
        # The end of the last poll again, a record twice, and a stretch that skips 31 to 39.
        [*rows(range(18, 31), 1), *rows([25], 1), *rows(range(40, 46), 2), *rows(range(4, 9), channel="b")],
        # The skipped stretch comes late, with both its borders again.
        rows(range(29, 42)),
        # The log was cleared: lower numbers, later times.
        [*rows(range(1, 8), day=3), *rows([9], channel="b")],
        [*rows(range(6, 10), day=3), *rows([2, 9], channel="b")],
    ]
    cursors = spark.createDataFrame([("a", 15), ("c", 3), ("d", None)], "channel string, record_number bigint")
    got = deliver(spark, tmp_path, RECORDS, polls, lambda s: keyed.new_records(s, cursors, backfill=3, poll="poll"))
    numbers = [[(c, n) for c, n, *_ in part] for part in got]
    assert numbers[0] == [("a", n) for n in range(16, 21)] + [("b", n) for n in (3, 4, 5)]
    assert numbers[1] == [("a", n) for n in [*range(21, 31), *range(40, 46)]] + [("b", n) for n in (6, 7, 8)]
    assert numbers[2] == [("a", n) for n in range(31, 40)]
    assert numbers[3] == [("a", n) for n in (5, 6, 7)] + [("b", 9)]
    assert numbers[4] == [("a", 8), ("a", 9)]
    assert all(note == f"{c}{n}" for part in got for c, n, _, _, note in part)


def visit(day, url, poll=0, profile="p"):
    return (profile, T0 + dt.timedelta(days=day), url, poll)


def test_visits(spark, tmp_path):
    polls = [
        [visit(1, "a"), visit(2, "a"), visit(2, "b"), visit(2, "b"), visit(0, "old", profile="q"), visit(5, "k", profile="q"), visit(5, "m", profile="q"), (None, T0, "x", 0), ("p", None, "x", 0)],
        # Day 2 again with one new URL; the days after it come first, days 3 and 4 are late.
        [visit(2, "a", 1), visit(2, "c", 1), visit(5, "a", 2), visit(6, "a", 2)],
        [visit(2, "b"), visit(2, "c"), visit(3, "z"), visit(5, "a"), visit(5, "n")],
        [visit(3, "never read, but inside"), visit(6, "a"), visit(6, "b")],
    ]
    day5 = T0 + dt.timedelta(days=5)
    cursors = spark.createDataFrame([("q", day5)], "profile_key string, last_visit timestamp_ntz")
    boundary = spark.createDataFrame([("k",)], "url string").selectExpr("'q' AS profile_key", "substring(sha2(url, 256), 1, 16) AS url_key")
    got = deliver(spark, tmp_path, VISITS, polls, lambda s: keyed.new_visits(s, cursors, boundary, backfill=None, poll="poll"))
    short = [[(p, (t - T0).days, u) for p, t, u, _ in part] for part in got]
    assert short[0] == [("p", 1, "a"), ("p", 2, "a"), ("p", 2, "b"), ("q", 5, "m")]
    assert short[1] == [("p", 2, "c"), ("p", 5, "a"), ("p", 6, "a")]
    assert short[2] == [("p", 3, "z"), ("p", 5, "n")]
    assert short[3] == [("p", 6, "b")]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_admits_every_record_once(spark, tmp_path, order):
    polls = [[("a", n, T0 + dt.timedelta(seconds=n), i, "") for n in range(10 * i, 10 * i + 13)] for i in range(3)]
    got = deliver(spark, tmp_path, RECORDS, [polls[i] for i in order], lambda s: keyed.new_records(s, backfill=None))
    assert sorted(r[1] for part in got for r in part) == list(range(33))
