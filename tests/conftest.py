import datetime as dt
import os

import pytest

from sleuthframe.session import build_session
from sleuthframe.vocabulary import EVENT_COLUMNS, EVENT_SCHEMA

DATA = os.environ.get("SLEUTH_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; ``at`` is seconds (or microseconds as ``at_us``) after a fixed start."""
    start = dt.datetime(2021, 1, 1, 10, 0, 0)

    def build(rows, start=start):
        out = []
        for i, row in enumerate(rows, 1):
            row = dict(row)
            ts = row.pop("ts", None)
            if "at" in row:
                ts = start + dt.timedelta(seconds=row.pop("at"))
            if "at_us" in row:
                ts = start + dt.timedelta(microseconds=row.pop("at_us"))
            full = {
                "id": i,
                "ts": ts,
                "source": "FileSystem",
                "event_type": "X",
                "description": "d",
                "severity": "INFO",
                "user": "",
                "device": "",
                "file_path": "",
                "metadata": "",
                "event_hash": None,
                "previous_hash": None,
                **row,
            }
            out.append(tuple(full[c] for c in EVENT_COLUMNS))
        return spark.createDataFrame(out, EVENT_SCHEMA)

    return build
