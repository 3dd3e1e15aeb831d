import datetime as dt

from sleuthframe.operators import scoring
from sleuthframe.operators.baseline import learn
from sleuthframe.streaming import profiles


def rows(scored):
    return sorted((r["id"], r["anomaly_score"], r["classification"], r["signals"]) for r in scored.collect())


def test_scores_by_stored_counts_equal_scores_on_the_union(spark, tmp_path, make_events):
    day = 86_400
    made = [{"at": (i % 9) * day + i * 600, "device": f"D{i % 3}", "user": "u" if i % 4 else "", "source": "USB" if i % 25 else "Browser"} for i in range(120)]
    events = make_events([*made, {"ts": None}]).cache()
    path = str(tmp_path)
    assert profiles.version(spark, path) == -1
    for n in range(3):
        for _ in range(2 if n == 1 else 1):  # a repeated micro-batch counts once
            profiles.count_batch(events.where(f"id % 3 = {n}"), path, n)
        seen = events.where(f"id % 3 <= {n}")
        found, at = profiles.score_when_new(events, path, n - 1)
        assert at == n and rows(found) == rows(scoring.score(events, learn(seen)))
        if n == 1:
            profiles.squash(spark, path)
            profiles.count_batch(events.where(f"id % 3 = {n}"), path, n)  # repeated after it was squashed
    assert profiles.score_when_new(events, path, 2) == (None, 2)
    first, last = dt.date(2021, 1, 3), dt.date(2021, 1, 6)
    window = events.where(f"to_date(ts) BETWEEN '{first}' AND '{last}'")
    assert rows(profiles.score_when_new(events, path, -1, first, last)[0]) == rows(scoring.score(events, learn(window)))
    assert profiles.squash(spark, path) == 2
    assert rows(profiles.score_when_new(events, path, -1)[0]) == rows(scoring.score(events, learn(events)))
