"""Sliding-window admission: at most so many events per key and window; denied events don't count."""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "event_id bigint, key bigint, ts timestamp, allowed boolean"
#: So many rows of a key are held at once in a stream; more are sorted in pieces on the task's disk and merged.
PIECE = 50_000
ROW = np.dtype([("ts", "i8"), ("known", "i1"), ("event_id", "i8")])


class Window:
    """The admitted times of one key that are still within the window: never more than the limit."""

    def __init__(self, limit: int, seconds: float, times: tuple = ()):
        self.limit, self.width, self.times = limit, pd.Timedelta(seconds=seconds), deque(times)

    def admit(self, at: pd.Timestamp) -> bool:
        while self.times and self.times[0] < at - self.width:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def admitted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Batch: (event_id, key, ts, allowed) of ``events``(event_id, key, ts), in order of ts and event_id per key.

    Admission depends on all that came before, so a key is one sequence; it is streamed through its task in sorted
    order and only the window's times are kept, so a hot key costs time but no memory. Rows without key or time
    are dropped.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Window(limit, seconds)
        for part in parts:
            allowed = []
            for k, ts in zip(part["key"], part["ts"]):
                if k != key:
                    key, window = k, Window(limit, seconds)
                allowed.append(window.admit(ts))
            yield part.assign(allowed=allowed)

    rows = events.where("key is not null and ts is not null").selectExpr("cast(event_id as bigint) as event_id", "cast(key as bigint) as key", "cast(ts as timestamp) as ts")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, SCHEMA)


def in_order(parts: Iterator[pd.DataFrame], piece: int = PIECE) -> Iterator[np.ndarray]:
    """The rows of ``parts``(ts, known, event_id) as arrays of ROW in order of ts and event_id, null ones (not known)
    first, of about ``piece`` rows at most."""

    def ordered(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate([np.empty(0, ROW), *held])
        return rows[np.lexsort((rows["event_id"], rows["known"], rows["ts"]))]

    def read(start: int, n: int, step: int) -> Iterator[tuple]:
        for at in range(0, n, step):
            file.seek(start + at * ROW.itemsize)
            yield from np.frombuffer(file.read(min(step, n - at) * ROW.itemsize), ROW).tolist()

    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
        runs, held, n = [], [], 0
        for part in parts:
            rows = np.empty(len(part), ROW)
            rows["ts"], rows["known"], rows["event_id"] = part["ts"].to_numpy("datetime64[us]").astype("i8"), part["known"], part["event_id"]
            held.append(rows)
            n += len(rows)
            if n >= piece:
                runs.append((file.tell(), n))
                file.write(ordered(held).tobytes())
                held, n = [], 0
        last = ordered(held)
        if not runs:
            yield last
            return
        step = max(1, piece // len(runs))
        merged = heapq.merge(*(read(*run, step) for run in runs), last.tolist())
        while rows := list(islice(merged, piece)):
            yield np.array(rows, ROW)


def admitted_stream(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Stream: the same with the window's times as the state of each key. A key's events of one batch are taken in
    order of time together, sorted outside memory, so a hot key costs time and disk but no memory."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = tuple(pd.Timestamp(t) for t in state.get[0]) if state.exists else ()
        window = Window(limit, seconds, times)
        for rows in in_order(parts):
            ts = pd.Series(rows["ts"].astype("datetime64[us]"))
            ids = pd.arrays.IntegerArray(rows["event_id"].copy(), rows["known"] == 0)
            yield pd.DataFrame({"event_id": ids, "key": key[0], "ts": ts, "allowed": [window.admit(t) for t in ts]})
        state.update(([t.isoformat() for t in window.times],))

    rows = events.where("key is not null and ts is not null").selectExpr(
        "coalesce(cast(event_id as bigint), 0) as event_id", "event_id is not null as known", "cast(key as bigint) as key", "cast(ts as timestamp) as ts"
    )
    return rows.groupBy("key").applyInPandasWithState(update, SCHEMA, "times array<string>", "append", GroupStateTimeout.NoTimeout)
