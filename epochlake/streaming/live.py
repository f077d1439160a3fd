"""The same operators over live events: blocks, validity, onsets, and parameters that follow the signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.stats import kalman


def live_blocks(events: DataFrame, keys: list[str], gap_s: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Blocks of events, closed by a gap; the watermark bounds what is held for late ones."""
    own = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, f"{gap_s} seconds").alias("w"))
    return own.agg(F.count(F.lit(1)).alias("trials"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(*keys, "first", "last", "trials")


def live_share(samples: DataFrame, keys: list[str], flag: str, width: str = "5 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Share of samples with a flag in tumbling windows."""
    own = samples.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
    return own.agg(F.avg(F.col(flag).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "share", "n")


def live_onsets(samples: DataFrame, key: str, order: str = "idx", code: str = "code") -> DataFrame:
    """Samples at which a key's code rises from 0; state is the last code of each key."""
    kind = samples.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for pdf in [pd.concat(list(frames)).sort_values(order)]:
            before = pdf[code].shift(fill_value=last)
            last = int(pdf[code].iloc[-1])
            yield pdf[(before == 0) & (pdf[code] > 0)][[key, order, code]]
        state.update((last,))

    return samples.select(key, order, code).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} bigint, {code} bigint", "last bigint", "append", "NoTimeout")


def live_kalman(samples: DataFrame, key: str, order: str, y: str, x: list[str], **how) -> DataFrame:
    """Parameters of each key after each batch; state is their mean and covariance."""
    kind, m = samples.schema[key].dataType.simpleString(), len(x)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).dropna(subset=[y, *x]).sort_values(order)
        before = (np.array(state.get[0]), np.array(state.get[1]).reshape(m, m)) if state.exists else None
        path, _, (theta, p) = kalman(pdf[y].to_numpy(float), pdf[x].to_numpy(float), state=before, **how)
        state.update((theta.tolist(), p.ravel().tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [len(path)], "theta": [theta.tolist()]})

    return samples.select(key, order, y, *x).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n bigint, theta array<double>", "theta array<double>, p array<double>", "update", "NoTimeout")
