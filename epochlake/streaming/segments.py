"""Live signals in order and by segment: rows wait until the watermark has passed them, a gap ends a segment and its state.

Both give what the batch operators give over the same rows, however late rows come within the watermark's delay, and hold
nothing of a segment once it has ended. They need a state store that has timers: the session's
``spark.sql.streaming.stateStore.providerClass`` is to be that of RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.stats import kalman


class Segments(StatefulProcessor):
    """Feeds a key's rows to ``begin``, ``feed`` and ``end`` in the order of time, from segment to segment.

    Waiting rows are a list state; a segment's numbers, with the time of its last row, a value state. A timer at a row's time
    goes off when the watermark is there: what is due then is fed. One at the gap's length after the last row ends the segment.
    """

    def __init__(self, key: str, names: Sequence[str], gap_us: int):
        self.key, self.names, self.gap = key, list(names), gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, v array<double>")
        self.segment = handle.getValueState("segment", "last bigint, v array<double>")

    def close(self) -> None:
        pass

    def begin(self, us: int) -> list[float]:
        raise NotImplementedError

    def feed(self, state: list[float], us: list[int], v: np.ndarray) -> tuple[list[float], list[list]]:
        raise NotImplementedError

    def end(self, state: list[float]) -> list[list]:
        return []

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(int(us), [float(x) for x in v]) for us, v in zip(pdf["us"], pdf["v"], strict=True)])
                last = max(int(pdf["us"].max()), last or 0)
        if last is not None:
            self._wake(last)
        yield pd.DataFrame(columns=[self.key, *self.names])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(us), list(v)) for us, v in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        held = self.segment.get() if self.segment.exists() else None
        last, state = (int(held[0]), list(held[1])) if held else (None, [])
        out: list[list] = []
        while due:
            if last is None or due[0][0] - last > self.gap:
                if last is not None:
                    out += self.end(state)
                state, last = self.begin(due[0][0]), due[0][0]
            n = 1
            while n < len(due) and due[n][0] - due[n - 1][0] <= self.gap:
                n += 1
            state, made = self.feed(state, [r[0] for r in due[:n]], np.array([r[1] for r in due[:n]], float))
            out += made
            last, due = due[n - 1][0], due[n:]
        if last is not None and passed - last > self.gap:
            out += self.end(state)
            last = None
        if last is None:
            self.segment.clear()
        else:
            self.segment.update((last, state))
            self._wake(last + self.gap)
        if rest:
            self.waiting.put(rest)
            self._wake(rest[-1][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame([[key[0], *r] for r in out], columns=[self.key, *self.names])


class Onsets(Segments):
    """State is the last code."""

    def begin(self, us: int) -> list[float]:
        return [0.0]

    def feed(self, state: list[float], us: list[int], v: np.ndarray) -> tuple[list[float], list[list]]:
        before = np.r_[state[0], v[:-1, 1]]
        return [float(v[-1, 1])], [[int(i), int(c)] for i, c in v[(before == 0) & (v[:, 1] > 0)]]


class Filter(Segments):
    """State is the segment's start, the number of samples, the sum of squared errors, the parameters and their covariance."""

    def __init__(self, key: str, names: Sequence[str], gap_us: int, m: int, how: dict):
        super().__init__(key, names, gap_us)
        self.m, self.how = m, how

    def begin(self, us: int) -> list[float]:
        return [float(us), 0.0, 0.0, *np.zeros(self.m), *(np.eye(self.m) * self.how.get("p0", 1e3)).ravel()]

    def feed(self, state: list[float], us: list[int], v: np.ndarray) -> tuple[list[float], list[list]]:
        m = self.m
        theta, p = np.array(state[3 : 3 + m]), np.array(state[3 + m :]).reshape(m, m)
        _, ahead, (theta, p) = kalman(v[:, 1], v[:, 2:], state=(theta, p), **self.how)
        return [state[0], state[1] + len(v), state[2] + float(((v[:, 1] - ahead) ** 2).sum()), *theta, *p.ravel()], []

    def end(self, state: list[float]) -> list[list]:
        n = int(state[1])
        return [[int(state[0]), n, [float(x) for x in state[3 : 3 + self.m]], float(np.sqrt(state[2] / n))]]


def _fed(samples: DataFrame, key: str, ts: str, late: str, values: Sequence[str]) -> DataFrame:
    """(key, us, v, ts): samples as numbers, without those that lack one."""
    own = samples.dropna(subset=[key, ts, *values]).withWatermark(ts, late)
    return own.select(key, F.unix_micros(ts).alias("us"), F.array(*[F.col(c).cast("double") for c in values]).alias("v"), ts)


def live_segment_onsets(samples: DataFrame, key: str, gap_s: float, order: str = "idx", code: str = "code", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, order, code): samples at which a key's code rises from 0, in order of time; it is 0 before a segment's first."""
    kind = samples.schema[key].dataType.simpleString()
    run = Onsets(key, [order, code], int(gap_s * 1e6))
    return _fed(samples, key, ts, late, [order, code]).groupBy(key).transformWithStateInPandas(run, f"{key} {kind}, {order} bigint, {code} bigint", "Append", "EventTime")


def live_segment_kalman(samples: DataFrame, key: str, gap_s: float, y: str, x: Sequence[str], order: str = "idx", ts: str = "ts", late: str = "10 minutes", **how) -> DataFrame:
    """(key, began, n, theta, rmse): a row for each segment once it has ended: its first time in microseconds, samples, the
    parameters after the last, and the error of predictions."""
    kind = samples.schema[key].dataType.simpleString()
    run = Filter(key, ["began", "n", "theta", "rmse"], int(gap_s * 1e6), len(x), how)
    return _fed(samples, key, ts, late, [order, y, *x]).groupBy(key).transformWithStateInPandas(run, f"{key} {kind}, began bigint, n bigint, theta array<double>, rmse double", "Append", "EventTime")
