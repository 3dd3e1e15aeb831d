"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from sleuthframe.plans.catalog import QUERIES
from sleuthframe.plans.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "event_scan", "events_page", "related_events", "src_windows", "src_defender", "src_usb", "normalize", "ingest_order",
    "tag_text", "extract_tokens", "batch_retrieve_rows", "incidents", "pair_signals", "anomaly_scores",
    "chain_verdicts", "hwm_incremental", "stream_ingest", "stream_hwm", "stream_dedup", "stream_browser",
    "stream_scores", "stream_incidents", "stream_counters",
]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return round(float(v), 6) if isinstance(v, float) else v


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False, name=None))


def test_keys_match():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, data, name):
    got = entry_points.queries()[name](spark, data).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).df()
    assert table(got) == table(want)
