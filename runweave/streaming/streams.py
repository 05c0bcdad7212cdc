"""Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch
from ..sources import logtext


#: Buckets of keys that a stream without a time folds; a bucket's states are read and written together.
BUCKETS = 4096
#: Buckets of keys whose rows wait for the watermark; each costs a timer and calls to the state in every batch.
WAITING = 1024
#: The setting of the most tasks that look up files.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot facts of log files as they arrive in a folder; a file is read whole once it is there (``sources.growing`` for logs still written)."""
    raw = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return logtext.block_facts(logtext.block_texts(raw).filter("block >= 0"))


class Fold:
    """What a stream carries along for a key: its state and what rows, in the order of ``order``, make of it."""

    #: Columns of a row besides the key, the order of rows, the state, columns of a result besides the key.
    rows: str
    order: list[str]
    state: str
    out: str

    def step(self, state: tuple | None, rows: pd.DataFrame | dict[str, np.ndarray]) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sorted(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """Rows in order; equal ones stay as they came."""
    return rows.iloc[np.lexsort([rows[c].to_numpy() for c in reversed(order)])] if len(rows) > 1 else rows


def _arrays(schema: str) -> str:
    return ", ".join("{} array<{}>".format(*x.split()) for x in schema.split(", "))


def _folded_keys(fold: Fold, key: str, rows: pd.DataFrame, had: tuple | None) -> tuple[tuple | None, list[tuple]]:
    """Folds the rows of many keys; their states are arrays, keys first, both in ``had`` and in what is returned with the results."""
    rows = _sorted(rows, [key, *fold.order])
    keys, values = rows[key].to_numpy(), {c: rows[c].to_numpy() for c in _names(fold.rows)}
    states, found = dict(zip(had[0], zip(*had[1:]))) if had else {}, []
    marks = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
    for a, b in zip(marks, marks[1:]):
        of = keys[a].item() if isinstance(keys[a], np.generic) else keys[a]
        now, own = fold.step(states.get(of), {c: v[a:b] for c, v in values.items()})
        if now is not None:
            states[of] = now
        found += [(of, *x) for x in own]
    return ((list(states), *map(list, zip(*states.values()))) if states else None), found


def at_once(fold: Fold, key: str):
    """Folds the rows of each batch as they come, in order within the batch: keys of a bucket together, the state of each by its place in arrays."""
    out = [key, *_names(fold.out)]

    def folded(_, parts, state) -> Iterator[pd.DataFrame]:
        states, found = _folded_keys(fold, key, pd.concat(list(parts)), state.get if state.exists else None)
        if states is not None:
            state.update(states)
        if found:
            yield pd.DataFrame(found, columns=out)

    return folded


class InOrder(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them, and are then folded in order, whatever batches they came in.

    A bucket of keys holds what lies within the watermark's delay, an array a column, and the states of its keys. It has a timer at
    the first row it holds.
    """

    def __init__(self, fold: Fold, key: str, kind: str):
        self.fold, self.key, self.kind = fold, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _arrays(f"{self.key} {self.kind}, {self.fold.state}"))
        rows = f"{self.key} {self.kind}, at_ms long, {self.fold.rows}"
        self.handle, self.columns = handle, _names(rows)
        self.held = handle.getListState("held", _arrays(rows))

    def _hold(self, rows: pd.DataFrame) -> None:
        self.held.appendValue(tuple(rows[c].to_numpy().tolist() for c in self.columns))
        self.handle.registerTimer(int(rows["at_ms"].min()) - 1)  # expired at the row's own moment, whether or not a timer counts that

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._hold(pd.concat(list(rows)))
        yield pd.DataFrame(columns=[self.key, *_names(self.fold.out)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame(dict(zip(self.columns, x))) for x in self.held.get()]
        held = pd.concat(parts) if parts else pd.DataFrame(columns=self.columns)
        ready = held["at_ms"] <= timerValues.getCurrentWatermarkInMs()
        found = []
        if ready.any():
            self.held.clear()
            if not ready.all():
                self._hold(held[~ready])
            had = tuple(self.state.get()) if self.state.exists() else None
            states, found = _folded_keys(self.fold, self.key, held[ready], had)
            if states is not None:
                self.state.update(states)
        elif len(held):
            self.handle.registerTimer(int(held["at_ms"].min()))
        yield pd.DataFrame(found, columns=[self.key, *_names(self.fold.out)])

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, fold: Fold, key: str, kind: str, at: str | None, delay: str) -> DataFrame:
    out = f"{key} {kind}, {fold.out}"
    bucket = F.pmod(F.hash(key), F.lit(BUCKETS if at is None else WAITING))
    if at is None:
        held = _arrays(f"keys {kind}, {fold.state}")
        return stream.withColumn("__bucket", bucket).groupBy("__bucket").applyInPandasWithState(at_once(fold, key), out, held, "append", GroupStateTimeout.NoTimeout)
    timed = stream.withWatermark(at, delay).withColumns({"at_ms": F.unix_millis(F.col(at)), "__bucket": bucket})
    return timed.groupBy("__bucket").transformWithStateInPandas(InOrder(fold, key, kind), out, "Append", "EventTime")


class Trapezoid(Fold):
    """Running trapezoid of y over t; time that runs backward adds nothing."""

    rows, order, state, out = "t double, y double", ["t", "y"], "t double, y double, total double", "t double, y double, total double"

    def step(self, state, rows):
        found = []
        for t, y in zip(rows["t"].tolist(), rows["y"].tolist()):
            total = 0.0 if state is None else state[2] + 0.5 * (y + state[1]) * max(t - state[0], 0.0)
            state = (float(t), float(y), float(total))
            found.append(state)
        return state, found


def cumulative(stream: DataFrame, key: str, kind: str = "long", *, at: str | None = None, delay: str = "1 minute") -> DataFrame:
    """``stream``: key, t, y; the running integral of y after each row.

    With ``at``, a timestamp that follows t, rows are taken in order of t however they
    arrive within ``delay``. Without it they are in order within a batch only: a row earlier
    than what a batch before had adds nothing, but is the last point from then on.
    """
    return _folded(stream, Trapezoid(), key, kind, at, delay)


class Front(Fold):
    """Front position, snapshot by snapshot; the thresholds are given, as a stream does not know all scores."""

    rows, order, state, out = "snapshot_index int, interface_id int, score double", ["snapshot_index", "interface_id"], "at int, snapshot int", "snapshot_index int, track_index int"

    def __init__(self, threshold: float, falling: bool, forward: int, backward: int):
        self.threshold, self.falling, self.forward, self.backward = threshold, falling, forward, backward

    def step(self, state, rows):
        at, seen = state or (None, -1)
        found = []
        snapshots, places, scores = (np.asarray(rows[c]) for c in ("snapshot_index", "interface_id", "score"))
        marks = np.flatnonzero(np.r_[True, snapshots[1:] != snapshots[:-1], True]).tolist() if len(snapshots) else []
        for a, b in zip(marks, marks[1:]):
            s, place, score = int(snapshots[a]), places[a:b], scores[a:b]
            if s <= seen:
                continue  # late: the front has moved on
            if at is None:
                if not score.max() >= self.threshold:
                    continue
                at = int(place[score.argmax()])
            else:
                low, high = (at - self.forward, at + self.backward) if self.falling else (at - self.backward, at + self.forward)
                near = (low <= place) & (place <= high)
                if near.any():
                    place, score = place[near], score[near]
                    pick = (score - 0.015 * self.threshold * np.abs(place - at)).argmax()
                    if score[pick] >= max(0.005, 0.25 * self.threshold):
                        at = int(place[pick])
            seen = s
            found.append((seen, at))
        return (None if at is None else (at, seen)), found


def front(stream: DataFrame, *, threshold: float, falling: bool = True, forward: int = 48, backward: int = 4, at: str | None = None, delay: str = "1 minute") -> DataFrame:
    """``stream``: run_id, snapshot_index, interface_id, score.

    With ``at``, a timestamp that follows the snapshots, a snapshot's rows may come in any batches within
    ``delay``. Without it a snapshot must lie in one batch, and one that comes late is left out.
    """
    return _folded(stream, Front(threshold, falling, forward, backward), "run_id", "long", at, delay)


class Backward(Fold):
    """Rows whose time is before the latest seen."""

    rows, order, state, out = "n long, t double", ["n"], "t double", "n long, t double, latest double"

    def step(self, state, rows):
        latest, found = state[0] if state else float("-inf"), []
        for n, t in zip(rows["n"].tolist(), rows["t"].tolist()):
            if t < latest:
                found.append((int(n), float(t), float(latest)))
            latest = max(latest, float(t))
        return (latest,), found


def out_of_order(stream: DataFrame, *, at: str | None = None, delay: str = "1 minute") -> DataFrame:
    """``stream``: key (long), n (arrival number), t. ``at``: a timestamp that follows n, if rows may come in any batches within ``delay``."""
    return _folded(stream, Backward(), "key", "long", at, delay)


def run_status(stream: DataFrame, key: str = "run_id") -> DataFrame:
    """Count and last time per run so far; whether a run is truncated is known when its last block is."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max("time_s").alias("last_time"), F.max_by("valid", "snapshot_index").alias("last_valid"))


def means(stream: DataFrame, at: str, late: str, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted means per keys and window of the arrival time.

    In append mode a window appears once the watermark has passed it, so those still
    open at the end never do; complete mode has them all.
    """
    w = F.window(at, late)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count("*").alias("n"))


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a table in the scratch folder.

    In append mode the rows of all batches; in complete or update mode those of the last state: each batch is
    a folder of its own, written again if the batch is repeated.
    """
    spark = stream.sparkSession
    folder = scratch(spark, what)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}" if mode == "append" else f"{folder}/rows/batch=0")

    # a batch looks up its files anew, in a task each up to this many; a task a core or so does for many small ones
    had = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        (stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()).awaitTermination()
    finally:
        spark.conf.set(LISTERS, had)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(stream.columns)
