"""Device health as a keyed state machine over outcomes that arrive late and out of order.

A device's state is what it is (healthy or quarantined), since when, and the series it is in; beside it lies a buffer of outcomes. An outcome waits there
until the watermark has passed its event time: by then everything that may come before it has come. Then the buffer is
taken in order of event time, an event-time timer asking for the rest. So batches may overlap in event time as they like, and the
state after them is that of the ordered series. The buffer holds the outcomes of one device within the watermark's delay,
many to a row of state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leeward.config import Limits

STATE = "state string, since_s long, run_bad boolean, run_n long, last_s long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "at_s binary, path binary, bad binary, paths array<string>"      # many outcomes a row
PACK = 100_000
HEALTH = "device_id string, state string, since_s long, run_n long, last_s long"


class Health(StatefulProcessor):
    """Quarantined after ``bad_run`` bad outcomes in a row, healthy again after ``good_run`` good ones."""

    def __init__(self, bad_run: int, good_run: int):
        self.bad_run, self.good_run = bad_run, good_run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [(f["at_s"].to_numpy(np.int64), f["ingestion_path"].to_numpy(object), f["bad"].to_numpy(bool)) for f in rows if len(f)]
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), came)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key: Any, watermark_ms: int, came: list[tuple] | None = None) -> Iterator[pd.DataFrame]:
        at_s, paths, bad = in_order([*map(unpacked, self.waiting.get()), *(came or [])])
        n = int(np.searchsorted(at_s, watermark_ms // 1000, "right"))
        if n:
            state = tuple(self.state.get()) if self.state.exists() else ("healthy", None, None, 0, None)
            for when, is_bad in zip(at_s[:n].tolist(), bad[:n].tolist()):
                state = step(state, when, is_bad, self.bad_run, self.good_run)
            self.state.update(state)
            name, since_s, _, run_n, last_s = state
            yield pd.DataFrame({"device_id": [key[0]], "state": [name], "since_s": pd.array([since_s], "Int64"), "run_n": [run_n], "last_s": [last_s]})
        if n < len(at_s):
            self.waiting.put([packed(at_s[i:i + PACK], paths[i:i + PACK], bad[i:i + PACK]) for i in range(n, len(at_s), PACK)])
            self.handle.registerTimer(int(at_s[n]) * 1000)
        elif n:
            self.waiting.clear()


def in_order(parts: list[tuple]) -> tuple:
    """Outcomes (at_s, path, bad) by time, then path, then outcome."""
    if not parts:
        return np.array([], np.int64), np.array([], object), np.array([], bool)
    at_s, paths, bad = (np.concatenate(column) for column in zip(*parts))
    _, rank = np.unique(paths.astype(str), return_inverse=True)
    order = np.lexsort((bad, rank, at_s))
    return at_s[order], paths[order], bad[order]


def packed(at_s, paths, bad) -> tuple:
    """Many outcomes as one row of state; one row each cost a round trip to the state store apiece."""
    names, code = np.unique(paths.astype(str), return_inverse=True)
    return at_s.tobytes(), code.astype(np.int32).tobytes(), bad.astype(np.uint8).tobytes(), names.tolist()


def unpacked(row: tuple) -> tuple:
    at_s, code, bad, names = row
    return (np.frombuffer(bytes(at_s), np.int64), np.array(names, object)[np.frombuffer(bytes(code), np.int32)],
            np.frombuffer(bytes(bad), np.uint8).astype(bool))


def step(state: tuple, at_s: int, bad: bool, bad_run: int, good_run: int) -> tuple:
    """(state, since, series outcome, series length, last) after one outcome."""
    name, since_s, run_bad, run_n, _ = state
    run_n = run_n + 1 if run_bad == bad else 1
    wanted = "quarantined" if bad and run_n == bad_run else "healthy" if not bad and run_n == good_run else name
    return (wanted, at_s if wanted != name else since_s, bad, run_n, at_s)


def health_stream(outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``outcomes``: a stream of (device_id, event_time, ingestion_path, bad). A row per device whenever its state has moved on.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Outcomes later than the lag limit have been routed away before; the watermark's delay is that limit and a second.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])          # the workers get the processor itself, wherever they run
    rows = outcomes.withWatermark("event_time", f"{limits.dedup_watermark_minutes * 60 + 1} seconds")
    rows = rows.select("device_id", "event_time", F.unix_seconds("event_time").alias("at_s"), "ingestion_path", "bad")
    return rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Health(limits.bad_run, limits.good_run), outputStructType=HEALTH, outputMode="Append", timeMode="EventTime")


def current_health(emitted: DataFrame) -> DataFrame:
    """The last state told for each device."""
    last = emitted.groupBy("device_id").agg(F.max(F.struct("last_s", "run_n", "state", "since_s")).alias("l"))
    return last.select("device_id", "l.state", "l.since_s", "l.last_s", "l.run_n")
