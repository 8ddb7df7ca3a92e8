"""Stateful streams with map state and timers: duplicate deliveries, and cached completions that expire.

They need Spark's RocksDB state store: start them inside `rocksdb_state`. Rows of one key and
micro-batch are put in order before they are judged, so a micro-batch of one key must fit in a
task (maxFilesPerTrigger and the like bound it); between micro-batches order is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB; the session's own choice returns afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class _Nudges(StatefulProcessor):
    """A lane's deliveries: first (id -> number of its first delivery), retried (original id -> number of the first delivery that names it) and acknowledged ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getMapState("first", "id string", "seq long")
        self._retried = handle.getMapState("retried", "id string", "seq long")
        self._done = handle.getMapState("acknowledged", "id string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _ordered(rows, ["seq"]).itertuples():
            name = (r.nudge_id,)
            if r.kind == "ack":
                if not self._done.containsKey(name):
                    self._done.updateValue(name, (int(r.seq),))
                continue
            first = self._first.getValue(name)[0] if self._first.containsKey(name) else None
            retried = self._retried.getValue(name)[0] if self._retried.containsKey(name) else None
            if self._done.containsKey(name) or retried is not None and (first is None or retried < first):
                found = "stale"
            else:
                found = "new" if first is None else "retry"
            if first is None:
                self._first.updateValue(name, (int(r.seq),))
                if isinstance(r.original_id, str) and not self._retried.containsKey((r.original_id,)):
                    self._retried.updateValue((r.original_id,), (int(r.seq),))
            out.append((key[0], r.seq, r.nudge_id, found, r.nudge_id if found == "new" else None))
        yield pd.DataFrame(out, columns=["lane", "seq", "nudge_id", "class", "delivered"])

    def close(self) -> None:
        pass


def classify_nudges(deliveries: DataFrame) -> DataFrame:
    """(lane, seq, nudge_id, class, delivered) for each nudge of a stream of deliveries and acknowledgements, in the order of seq.

    deliveries: (lane, seq, kind, nudge_id, original_id), kind `nudge` or `ack`, original_id the
    nudge that this one is a retry of, or null. A nudge is `stale` once its id is acknowledged, or if a
    retry that names it as its original came before its own first delivery; else `retry`
    if its id was delivered before, else `new`; new ones alone are delivered. Rows without a lane or an id are left out.
    """
    d = deliveries.select("lane", "seq", "kind", "nudge_id", "original_id").where("lane is not null and nudge_id is not null and kind in ('nudge', 'ack')")
    return d.groupBy("lane").transformWithStateInPandas(_Nudges(), "lane long, seq long, nudge_id string, class string, delivered string", "append", "none")


class _Completions(StatefulProcessor):
    """One request's cached completion: when it was stored, and its version; a timer drops it when it expires."""

    def __init__(self, ttl_ms: int, version: str):
        self._ttl, self._version = ttl_ms, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "at long, version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The entry is read before the rows and written after them: state and timers cost no call a row. Timers are due after a micro-batch's rows."""
        parts = [p for p in rows if len(p)]
        at, seq, kind, version = (np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0) for c in ("at", "seq", "kind", "version"))
        order = np.lexsort((seq, at))
        entry = before = tuple(self._entry.get()) if self._entry.exists() else None
        out = []
        for now, number, what, new in zip(*(x[order].tolist() for x in (at, seq, kind, version))):
            if what == "store":
                entry = (int(now), new)
                continue
            hit = entry is not None and entry[1] == self._version and now - entry[0] < self._ttl
            if not hit:
                entry = None
            out.append((key[0], number, hit))
        if entry != before:
            if before is not None:
                self._handle.deleteTimer(before[0] + self._ttl)
            if entry is None:
                self._entry.clear()
            else:
                self._entry.update(entry)
                self._handle.registerTimer(entry[0] + self._ttl)
        yield pd.DataFrame(out, columns=["request", "seq", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._entry.exists() and self._entry.get()[0] + self._ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self._entry.clear()
        yield pd.DataFrame({"request": pd.Series(dtype=object), "seq": pd.Series(dtype="int64"), "hit": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def cached_lookups(events: DataFrame, ttl: str = "30 seconds", version: str = "v1", late: str = "0 seconds") -> DataFrame:
    """(request, seq, hit) for each lookup of a stream of stored completions and lookups, in event time.

    events: (request, seq, kind, ts, version), kind `store` or `lookup`; request is a string, ts a timestamp, seq orders what
    shares it. A lookup hits the request's last completion if that has the present version and is
    younger than ttl (at ttl exactly it has expired); one that fails drops it. Completions go from
    the state when the watermark, `late` behind the latest event, passes their end. Rows without a request or a time are left out.
    """
    e = events.where("request is not null and ts is not null and kind in ('store', 'lookup')").withWatermark("ts", late)
    e = e.select("request", "seq", "kind", "ts", F.unix_millis("ts").alias("at"), "version")
    return e.groupBy("request").transformWithStateInPandas(_Completions(int(pd.Timedelta(ttl).total_seconds() * 1000), version), "request string, seq long, hit boolean", "append", "eventTime")
