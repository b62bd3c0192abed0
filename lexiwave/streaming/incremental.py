"""Streaming forms: running n-gram counts, overlapping frames of time, online Viterbi and its paths."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiwave.functions.shipping import ship
from lexiwave.operators.text import gram_rows, sequences


def running_counts(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(model, ord, gram, cnt) so far, for ``update`` or ``complete`` output: one aggregation, as streams take."""
    return gram_rows(sequences(texts, text), n).groupBy("model", "ord", "gram").agg(F.count("*").alias("cnt"))


def time_frames(events: DataFrame, time: str, length: str, step: str, late: str, *keys: str) -> DataFrame:
    """Count, mean and energy of values in overlapping frames of event time; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, step).alias("frame"), *keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum(F.col("value") * F.col("value")).alias("energy"))


def online_viterbi(observations: DataFrame, key: str, initial: np.ndarray, transitions: np.ndarray, emission: np.ndarray) -> DataFrame:
    """(key, frames, cost, state): the best path's cost and last state after each trigger.

    Rows have the key, an order column ``seq`` and a symbol number ``obs``. The state kept a key is one cost
    a state, however long the stream; rows of one trigger are put in order, and triggers must be in order.
    """
    n = len(initial)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        frames, cost = (state.get[0], np.array(state.get[1])) if state.exists else (0, None)
        for o in rows["obs"].to_numpy():
            e = emission[:, int(o)]
            cost = initial + e if cost is None else (cost[:, None] + transitions).min(0) + e
            frames += 1
        state.update((frames, cost.tolist()))
        yield pd.DataFrame({key: [k[0]], "frames": [frames], "cost": [float(cost.min())], "state": [int(cost.argmin())]})

    assert len(transitions) == n
    kind = observations.schema[key].dataType.simpleString()
    return observations.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frames long, cost double, state int", "frames long, cost array<double>", "update", GroupStateTimeout.NoTimeout)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which processors with states of their own need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class PathProcessor(StatefulProcessor):
    """Viterbi paths as observations come in.

    A key keeps the cost of the best path to every state, and back-pointers of those steps only on whose state
    the surviving paths do not yet agree. Once they all come through one state, no later observation can change
    the path up to it: that part is given out as settled and its back-pointers go.
    """

    def __init__(self, key: str, initial: np.ndarray, transitions: np.ndarray, emission: np.ndarray, idle_ms: int | None = None):
        self.key, self.initial, self.transitions, self.emission, self.idle_ms = key, initial, transitions, emission, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "began string, last string, frames long, settled long, cost array<double>")
        self.back = handle.getListState("back", "came array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, new = len(self.initial), pd.concat(list(rows)).sort_values("seq", kind="stable")
        began, last, frames, settled, cost = self.now.get() if self.now.exists() else (None, None, 0, 0, None)
        cost = None if cost is None else np.array(cost)
        came = [np.array(r[0]).reshape(-1, n) for r in self.back.get()] if frames else []
        for seq, o in zip(new["seq"], new["obs"]):
            if last is not None and seq <= last:
                continue  # late or repeated
            e = self.emission[:, int(o)]
            ways = None if cost is None else cost[:, None] + self.transitions
            came.append(np.arange(n)[None] if ways is None else ways.argmin(0)[None])
            cost = self.initial + e if ways is None else ways.min(0) + e
            began, last, frames = seq if began is None else began, seq, frames + 1
        if cost is not None:
            path, sure = _agreed(np.concatenate(came), cost) if came else (np.zeros(0, np.int64), 0)
            rest = np.concatenate(came)[sure:] if came else np.zeros((0, n))
            self.now.update((began, last, frames, settled + sure, cost.tolist()))
            self.back.put([(rest.ravel().astype(int).tolist(),)])
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
            yield self._rows(key, began, settled, path, np.arange(len(path)) < sure, cost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, _, _, settled, cost = self.now.get()
        came = np.concatenate([np.array(r[0]).reshape(-1, len(cost)) for r in self.back.get()])
        path, _ = _agreed(came, np.array(cost)) if len(came) else (np.zeros(0, np.int64), 0)
        self.now.clear()
        self.back.clear()
        yield self._rows(key, began, settled, path, np.ones(len(path), bool), np.array(cost))

    def close(self) -> None:
        pass

    def _rows(self, key, began: str, first: int, path: np.ndarray, settled: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
        t = np.arange(first, first + len(path))
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(t), dtype=object), "began": began, "t": t, "state": path.astype("int32"), "settled": settled, "cost": float(cost.min())})


def _agreed(came: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, int]:
    """The best path over steps with back-pointers [m, n], and how many of them all finite paths share."""
    path, alive, sure = np.empty(len(came), np.int64), np.flatnonzero(np.isfinite(cost)), 0
    best, states = int(cost.argmin()), alive
    for t in range(len(came) - 1, -1, -1):
        path[t] = best
        if not sure and len(states) and (states == states[0]).all():
            sure = t + 1
        best, states = int(came[t, best]), came[t, states]
    return path, sure


def online_paths(observations: DataFrame, key: str, initial: np.ndarray, transitions: np.ndarray, emission: np.ndarray, idle_ms: int | None = None) -> DataFrame:
    """(key, began, t, state, settled, cost) for update output: after each trigger a key's newly settled steps, and its open ones as they look now.

    Rows have the key, an order column ``seq`` (string) and a symbol number ``obs``; rows of a trigger are put
    in order, and rows that are not behind what was read before are left out. ``t`` counts a run's steps from
    0 and ``began`` is the seq of its first. A table keyed by (key, began, t) that keeps the latest rows holds
    the batch path. After ``idle_ms`` without rows a key's open steps are settled as they are and its state
    goes; later rows begin a new run. Start the stream within ``rocks_state``.
    """
    ship(observations.sparkSession)
    kind = observations.schema[key].dataType.simpleString()
    processor = PathProcessor(key, initial, transitions, emission, idle_ms)
    return observations.select(key, F.col("seq").cast("string").alias("seq"), F.col("obs").cast("int").alias("obs")).groupBy(key).transformWithStateInPandas(
        processor, f"{key} {kind}, began string, t long, state int, settled boolean, cost double", "Update", "None" if idle_ms is None else "ProcessingTime")
