import datetime as dt

import pytest

from sleuthframe.operators.baseline import learn
from sleuthframe.operators.scoring import Thresholds, class_counts, score

MON, SAT = dt.datetime(2021, 1, 4), dt.datetime(2021, 1, 9)
BASE = {"source": "Windows", "event_type": "4624"}


def at(day, hour, n=1, **kw):
    return [{**BASE, "ts": day + dt.timedelta(hours=hour, minutes=i), **kw} for i in range(n)]


def one(make_events, past, event, **kw):
    base = learn(make_events(past), min_events=10)
    return score(make_events([event]), base, explain=True, **kw).first()


def test_low_hour_is_exactly_twenty(make_events):
    past = [e for h in range(24) for e in at(MON, h, 1 if h == 3 else 3)]
    got = one(make_events, past, at(MON, 3)[0])
    assert (got["anomaly_score"], got["signals"]) == (20.0, ["unusual_frequency"])
    assert "03:00" in got["reasons"][0] and "the endpoint" in got["reasons"][0]


def test_unseen_weekday_and_no_time(make_events):
    past = at(MON, 9, 20)
    got = one(make_events, past, at(SAT, 9)[0])
    assert got["signals"] == ["unusual_day"] and "Saturday" in got["reasons"][0]
    got = one(make_events, past, {**BASE, "ts": None})
    assert (got["signals"], got["reasons"]) == ([], ["Activity is consistent with the established baseline."])


def test_subject_hours(make_events):
    past = [e for h in range(9, 18) for e in at(MON, h, 2, user="alice")] + [e for h in range(6) for e in at(MON, h, 2, user="bob")]
    past += [e for h in range(8, 17) for e in at(MON, h, 2, device="A")] + [e for h in range(20, 24) for e in at(MON, h, 2, device="B")]
    base = learn(make_events(past), min_events=10)
    events = at(MON, 2, user="alice") + at(MON, 2, user="bob") + at(MON, 22, device="A")
    got = {r["id"]: r for r in score(make_events(events), base, explain=True).collect()}
    assert "unusual_hour" in got[1]["signals"] and "unusual_hour" not in got[2]["signals"]
    assert any("device 'A'" in r for r in got[3]["reasons"])


def test_new_and_rare_values(make_events):
    past = at(MON, 9, 97, user="u", device="d") + at(MON, 9, 3, user="rare", device="d")
    base = learn(make_events(past), min_events=10)
    events = [
        *at(MON, 9, user="u", device="d"),
        *at(MON, 9, user="rare", device="d"),
        *at(MON, 9, user="new", device="other"),
        *[{**e, "source": "USB", "event_type": "USB_CONNECTED", "severity": "HIGH"} for e in at(MON, 9, user="u", device="d")],
        *[{**e, "source": "Agent"} for e in at(MON, 9, user="u", device="d")],
    ]
    got = {r["id"]: r for r in score(make_events(events), base).collect()}
    assert [got[i]["anomaly_score"] for i in range(1, 6)] == [0.0, 12.0, 60.0, 90.0, 40.0]
    assert [got[i]["classification"] for i in range(1, 6)] == ["NORMAL", "NORMAL", "ANOMALOUS", "ANOMALOUS", "SUSPICIOUS"]
    assert got[4]["severity"] == "HIGH"
    assert got[5]["signals"] == ["unusual_source"]


def test_cold_start_and_limits(make_events):
    got = score(make_events(at(MON, 9, 5)), explain=True)
    assert {(r["classification"], r["anomaly_score"]) for r in got.collect()} == {("INSUFFICIENT_HISTORY", 0.0)}
    assert {r["classification"]: r["n"] for r in class_counts(got).collect()}["INSUFFICIENT_HISTORY"] == 5
    for bad in ({"rare_threshold": 2}, {"z_threshold": -1}, {"min_subject_events": 0}, {"suspicious_score": 70}):
        with pytest.raises(ValueError):
            Thresholds(**bad)


def test_own_history_equals_full_lookup(make_events):
    """The short way for own history gives what looking up every value gives."""
    past = at(MON, 9, 40, user="u") + at(SAT, 3, 1, user="x", device="d1") + at(MON, 10, 2, severity="odd")
    e = make_events(past)
    short = {r["id"]: (r["anomaly_score"], r["signals"]) for r in score(e).collect()}
    full = {r["id"]: (r["anomaly_score"], r["signals"]) for r in score(e, learn(e)).collect()}
    every = {r["id"]: (r["anomaly_score"], r["signals"]) for r in score(e, limits=Thresholds(rare_threshold=0.0)).collect()}
    assert short == full
    assert all("unusual_user" not in s for _, s in every.values())
