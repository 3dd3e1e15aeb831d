"""Cursors as keyed state of the stream.

Logs and browser histories are polled: each poll delivers a stretch of a source's rows, and the next one may deliver the end
of the last one again. The state of a source is the stretches it has delivered, as few (start, end) pairs as there are holes
between polls, so a poll that comes late, after its successors, fills its hole instead of being taken for old rows; stretches
that meet become one. The state lives in the state store of the stream: a restarted query goes on from it, a failed
micro-batch is repeated against the state before it, and nothing is read or written beside the rows.

``new_records`` keeps numbers per channel. ``new_visits`` keeps times per browser profile; several visits may share a time, so
the fingerprints of the rows at the two ends of every stretch are kept as well, in a map that forgets them after a while.

Rows of one poll of one source must come in one micro-batch; ``poll`` names the column that tells polls of one micro-batch
apart, without it the micro-batch is one poll of each source. A task holds the rows that one source delivers in one
micro-batch, which ``watch(files_per_batch=...)`` bounds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.cursors import url_key

# The functions of this module travel to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000
REMEMBER_MS = 90 * DAY_MS
# Everything up to a stored cursor has been read.
BEGINNING = -(1 << 62)


def use_state_store(df: DataFrame) -> None:
    """Keyed state needs this store; a query remembers the store that it was started with."""
    df.sparkSession.conf.set(STORE, ROCKSDB)


def merge_stretches(known: dict[int, int], fresh: list[tuple[int, int]], step: int) -> dict[int, int]:
    """Stretches that overlap or lie ``step`` apart at most become one."""
    out: dict[int, int] = {}
    last = None
    for start, end in sorted([*known.items(), *fresh]):
        if last is not None and start <= out[last] + step:
            out[last] = max(out[last], end)
        else:
            out[start], last = end, start
    return out


def _stretches_by_poll(frame, at: str, poll: str | None) -> list[tuple[int, int]]:
    if poll is None:
        return [(int(frame[at].min()), int(frame[at].max()))]
    found = frame.groupby(poll, dropna=False)[at].agg(["min", "max"])
    return [(int(a), int(b)) for a, b in found.to_numpy()]


def _store_stretches(state, known: dict[int, int], new: dict[int, int]) -> None:
    for start in known:
        if start not in new:
            state.removeKey((start,))
    for start, end in new.items():
        if known.get(start) != end:
            state.updateValue((start,), (end,))


def new_records(records: DataFrame, cursors: DataFrame | None = None, backfill: int | None = 100, poll: str | None = None) -> DataFrame:
    """Rows of a stream ``records(channel, record_number, ts, ...)`` that no earlier poll delivered.

    ``cursors(channel, record_number)`` is what an earlier run has read, for the first start. Of a channel that is met for the
    first time, or whose log was cleared, the newest ``backfill`` records are admitted, or all where it is None. A log was
    cleared when its numbers are below those read before but all its times are later; numbers below with earlier
    times belong to a late poll. Rows without channel or number are left out; a record that a micro-batch holds several times
    is admitted once.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    # Helper columns must not begin with an underscore: the workers would rename them.
    use_state_store(records)
    columns = records.columns

    class Records(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.stretches = handle.getMapState("stretches", "start bigint", "end bigint")
            self.latest = handle.getValueState("latest", "at bigint")

        def known(self) -> dict[int, int]:
            return {k[0]: v[0] for k, v in self.stretches.iterator()}

        def handleInitialState(self, key, initialState, timerValues) -> None:
            numbers = initialState["record_number"].dropna()
            if len(numbers):
                self.stretches.updateValue((BEGINNING,), (int(numbers.max()),))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frames = [f for f in rows if len(f)]
            if not frames:
                # A source that only has a stored cursor.
                return
            frame = pd.concat(frames, ignore_index=True).drop_duplicates("record_number")
            numbers = frame["record_number"].astype("int64")
            times = frame["state_us"].dropna()
            known = self.known()
            seen_at = self.latest.get()[0] if self.latest.exists() else None
            high = max(known.values(), default=None)
            below = high is not None and int(numbers.max()) < high
            if below and seen_at is not None and len(times) and int(times.min()) > seen_at:
                for start in known:
                    self.stretches.removeKey((start,))
                known = {}
            if known:
                inside = pd.Series(False, index=frame.index)
                for start, end in known.items():
                    inside |= numbers.between(start, end)
                admitted = frame[~inside]
            elif backfill is None:
                admitted = frame
            else:
                admitted = frame.loc[numbers.nlargest(backfill).index]
            _store_stretches(self.stretches, known, merge_stretches(known, _stretches_by_poll(frame, "record_number", poll), 1))
            if len(times) and (seen_at is None or int(times.max()) > seen_at):
                self.latest.update((int(times.max()),))
            yield admitted[columns]

        def close(self) -> None:
            pass

    valid = records.where("channel IS NOT NULL AND record_number IS NOT NULL")
    timed = valid.withColumn("state_us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = None if cursors is None else cursors.select("channel", F.col("record_number").cast("bigint")).groupBy("channel")
    return timed.groupBy("channel").transformWithStateInPandas(
        Records(), records.schema, outputMode="Append", timeMode="None", initialState=start
    )


def new_visits(
    visits: DataFrame,
    cursors: DataFrame | None = None,
    boundary: DataFrame | None = None,
    backfill: int | None = 100,
    poll: str | None = None,
    remember_ms: int = REMEMBER_MS,
) -> DataFrame:
    """Rows of a stream ``visits(profile_key, ts, url, ...)`` that no earlier poll delivered.

    ``cursors(profile_key, last_visit)`` and ``boundary(profile_key, url_key)`` are what an earlier run has read, for the first
    start. Of a profile met for the first time the newest ``backfill`` visits are admitted, or all where it is None.
    Visits inside a stretch have been read; at its ends those whose URL was read at that time. Fingerprints are forgotten
    ``remember_ms`` after they were written, on the clock of the workers. Rows without time or profile are left out; a visit
    that a micro-batch holds several times (same time and URL) is admitted once.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    use_state_store(visits)
    columns = visits.columns

    class Visits(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.stretches = handle.getMapState("stretches", "start bigint", "end bigint")
            self.ends = handle.getMapState("ends", "at bigint, url_key string", "there boolean", ttlDurationMs=remember_ms)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            last = initialState["state_us"].dropna()
            if not len(last):
                return
            at = int(last.max())
            self.stretches.updateValue((BEGINNING,), (at,))
            for name in initialState["url_key"].dropna():
                self.ends.updateValue((at, name), (True,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frames = [f for f in rows if len(f)]
            if not frames:
                return
            frame = pd.concat(frames, ignore_index=True).drop_duplicates(["state_us", "state_key"])
            times = frame["state_us"].astype("int64")
            known = {k[0]: v[0] for k, v in self.stretches.iterator()}
            if known:
                inside = pd.Series(False, index=frame.index)
                at_end = pd.Series(False, index=frame.index)
                for start, end in known.items():
                    inside |= (times > start) & (times < end)
                    at_end |= (times == start) | (times == end)
                for i in frame.index[at_end & ~inside]:
                    inside[i] = self.ends.containsKey((int(times[i]), frame.at[i, "state_key"]))
                admitted = frame[~inside]
            elif backfill is None:
                admitted = frame
            else:
                admitted = frame.sort_values(["state_us", "url"], ascending=[False, True], kind="stable").head(backfill)
            new = merge_stretches(known, _stretches_by_poll(frame, "state_us", poll), 0)
            _store_stretches(self.stretches, known, new)
            kept = {*new, *new.values()}
            for at, name in [k for k, _ in self.ends.iterator()]:
                if at not in kept:
                    self.ends.removeKey((at, name))
            for i in frame.index[times.isin(kept)]:
                self.ends.updateValue((int(times[i]), frame.at[i, "state_key"]), (True,))
            yield admitted[columns]

        def close(self) -> None:
            pass

    valid = visits.where("profile_key IS NOT NULL AND ts IS NOT NULL")
    timed = valid.withColumns({"state_us": F.unix_micros(F.col("ts").cast("timestamp")), "state_key": url_key(F.col("url"))})
    start = None
    if cursors is not None:
        last = cursors.select("profile_key", F.unix_micros(F.col("last_visit").cast("timestamp")).alias("state_us"))
        keys = boundary if boundary is not None else cursors.select("profile_key", F.lit(None).cast("string").alias("url_key"))
        start = last.join(keys, "profile_key", "left").select("profile_key", "state_us", "url_key").groupBy("profile_key")
    return timed.groupBy("profile_key").transformWithStateInPandas(
        Visits(), visits.schema, outputMode="Append", timeMode="ProcessingTime", initialState=start
    )
