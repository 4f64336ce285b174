"""Appending steps to series, in batch and as a stream (STR1)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoloom.functions.calendar import from_micros, micros
from chronoloom.operators.panel import with_calendar


def append_steps(history: DataFrame, new: DataFrame, keys: Sequence[str], step_us: int, order: str = "step") -> DataFrame:
    """Batch form: new values get the stamps after the last one, and time features.

    ``new`` is ``(keys, step, value)`` with 1-based steps.  Only the last stamp
    of each series is computed from the history.
    """
    last = history.groupBy(*keys).agg(F.max(micros("ts")).alias("_last"), F.max("t_idx").alias("_t"))
    stamped = new.join(last, list(keys)).select(
        *keys, (F.col("_t") + F.col(order)).alias("t_idx"),
        from_micros(F.col("_last") + F.col(order) * F.lit(step_us)).alias("ts"), "value")
    features = [c for c in ("tod", "dow", "dom", "doy") if c in history.columns]
    return history.unionByName(with_calendar(stamped, "ts", features))


class _Series(StatefulProcessor):
    """The newest steps of one series in order of event time, and what became of all others."""

    def __init__(self, key: str, in_len: int, delay_us: int):
        self.key, self.in_len, self.delay_us = key, in_len, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("steps", "us array<bigint>, v array<double>, steps bigint, late bigint")

    def _row(self, name: tuple, us: np.ndarray, v: np.ndarray, steps: int, late: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [name[0]], "last_us": [int(us[-1])], "steps": [steps], "late": [late], "ended": [ended],
                             "inputs": [v[-self.in_len:]]})

    def _kept(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        if not self.state.exists():
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        us, v, steps, late = self.state.get()
        return np.asarray(us, np.int64), np.asarray([np.nan if x is None else x for x in v], float), steps, late

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        us, v, steps, late = self._kept()
        before = int(us[-1]) if len(us) else None
        # steps before this cannot be told from repeated ones any more
        closed = min(int(us[0]), before - self.delay_us) if len(us) >= self.in_len else None
        for part in rows:
            new_us, new_v = part["us"].to_numpy(np.int64), part["v"].to_numpy(float)
            if closed is not None:
                open_ = new_us >= closed
                late += int((~open_).sum())
                new_us, new_v = new_us[open_], new_v[open_]
            both, place = np.unique(np.concatenate([us, new_us]), return_index=True)  # of equal stamps the first stays
            values = np.concatenate([v, new_v])[place]
            steps += len(both) - len(us)
            if len(both):
                keep = (both >= both[-1] - self.delay_us) | (np.arange(len(both)) >= len(both) - self.in_len)
                us, v = both[keep], values[keep]
        self.state.update((us.tolist(), v.tolist(), steps, late))
        if len(us) and before != int(us[-1]):
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            self.handle.registerTimer(int(us[-1]) // 1000)
        if len(us) >= self.in_len:
            yield self._row(key, us, v, steps, late, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        us, v, steps, late = self._kept()
        self.state.clear()
        if len(us) >= self.in_len:
            yield self._row(key, us, v, steps, late, True)

    def close(self) -> None:
        pass


def rolling_windows(
    stream: DataFrame, key: str, in_len: int, value: str = "value", ts: str = "ts", delay: str = "1 hour", idle: str = "30 days",
) -> DataFrame:
    """Stream form: the last ``in_len`` values of each series by event time, after every trigger.

    Steps may come in any order: one that is as new as the oldest step kept is
    put in its place, whatever trigger brings it.  Kept are the newest
    ``in_len`` and all within ``delay`` of the newest; a step older than those
    changes no window and is counted as ``late``.  A step with a stamp that is
    kept already is a repetition and counts once.

    A series that has no step for ``idle`` while others go on has ended: a timer
    on its last step emits a last row, with ``ended``, and removes its state;
    steps that old are no longer read.  A series yields a row once its window is
    full: ``(key, last_us, steps, late, ended, inputs)``.  The state lives in
    RocksDB (see drain()).
    """
    key_type = dict(stream.dtypes)[key]
    if "timestamp_ntz" in dict(stream.dtypes)[ts]:
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    delay_us = int(pd.Timedelta(delay).total_seconds() * 1e6)
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, idle).select(
        F.col(key), F.col(ts).alias("at"), micros(ts).alias("us"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).transformWithStateInPandas(
        _Series(key, in_len, delay_us),
        f"`{key}` {key_type}, last_us bigint, steps bigint, late bigint, ended boolean, inputs array<double>", "update", "EventTime")
