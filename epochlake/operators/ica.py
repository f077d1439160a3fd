"""Independent components of recordings of any length: fitted by sums over tasks, removed by a sheet, carried over to other data.

A recording's vectors over channels are packed in blocks of time, and blocks are what is spread. Each round sends the
recordings' unmixing matrices out and gets the sums of the gradient back, added up by Spark: numbers by channels times
channels, however long the recordings are. Weights are a table; removal is a channel operator, a join and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]
#: Places in time of a block.
BLOCK = 1 << 14


def _vectors(df: DataFrame, subject: str, index: str, channel: str, value: str, block: int) -> DataFrame:
    """(subject, x): blocks of complete vectors, one value for each channel in the order of channels, one vector after the other."""
    have = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = df.select(subject, channel).distinct().groupBy(subject).agg(F.count(F.lit(1)).alias("__c"))
    rows = have.groupBy(subject, index).agg(F.array_sort(F.collect_list(F.struct(channel, F.col(value).cast("double").alias("v")))).alias("s")).join(n, subject).where(F.size("s") == F.col("__c"))
    return rows.groupBy(subject, F.floor(F.col(index) / F.lit(block)).alias("__b")).agg(F.flatten(F.collect_list(F.col("s.v"))).alias("x")).select(F.col(subject).cast("string").alias("key"), "x")


def _sums(blocks: DataFrame, numbers) -> dict[str, np.ndarray]:
    """By recording, the sum over its blocks of what ``numbers`` (key, flat vectors) makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                made = numbers(key, batch.column(1)[i].values.to_numpy(zero_copy_only=False))
                total[key] = total[key] + made if key in total else made
        for key, v in total.items():
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], names=["key", "place", "v"])

    out: dict[str, dict[int, float]] = {}
    for r in blocks.mapInArrow(run, "key string, place long, v double").groupBy("key", "place").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r.key, {})[r.place] = r.v
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def fit(df: DataFrame, subject: str, index: str, channel: str, value: str, rounds: int = 200, rate: float = 0.1, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(unmixing: subject, component, channel, weight; mixing: the same) of each recording, by extended Infomax: the natural
    gradient with a switch between sub- and super-Gaussian sources. ``index`` is a whole number; a place where a channel lacks a
    value is left out. What goes through the driver is two matrices of channels by channels a recording and round."""
    spark = df.sparkSession
    names: dict[str, list] = {}
    for r in df.select(F.col(subject).alias("s"), F.col(channel).alias("c")).distinct().orderBy("s", "c").toLocalIterator():
        names.setdefault(str(r.s), []).append(r.c)
    count = {k: len(v) for k, v in names.items()}
    blocks = _vectors(df, subject, index, channel, value, block).persist()
    try:

        def moments(key: str, flat: np.ndarray) -> np.ndarray:
            x = flat.reshape(-1, count[key])
            return np.r_[len(x), x.sum(0), (x.T @ x).ravel()]

        state: dict[str, tuple] = {}
        for key, v in _sums(blocks, moments).items():
            c, n = count[key], v[0]
            if n < 2:
                continue
            mean = v[1 : c + 1] / n
            val, vec = np.linalg.eigh((v[c + 1 :].reshape(c, c) - n * np.outer(mean, mean)) / (n - 1))
            keep = val > val.max() * 1e-10
            white = (vec[:, keep] / np.sqrt(val[keep])).T
            k = len(white)
            state[key] = mean, white, np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((k, k)))[0], n, False

        for _ in range(rounds):
            live = {key: s[:3] for key, s in state.items() if not s[4]}
            if not live:
                break
            sent = spark.sparkContext.broadcast(live)

            def gradient(key: str, flat: np.ndarray) -> np.ndarray:
                if key not in sent.value:  # noqa: B023
                    return np.zeros(0)
                mean, white, w = sent.value[key]  # noqa: B023
                u = w @ (white @ (flat.reshape(-1, len(mean)) - mean).T)
                th = np.tanh(u)
                return np.r_[(th @ u.T).ravel(), (u @ u.T).ravel(), (1 / np.cosh(u) ** 2).sum(1)]

            for key, v in _sums(blocks, gradient).items():
                mean, white, w, n, _ = state[key]
                k = len(w)
                t, s, sech = v[: k * k].reshape(k, k) / n, v[k * k : 2 * k * k].reshape(k, k) / n, v[2 * k * k :] / n
                sign = np.sign(sech * np.diag(s) - np.diag(t))
                step = rate * (np.eye(k) - sign[:, None] * t - s) @ w
                state[key] = mean, white, w + step, n, bool(np.abs(step).max() < 1e-6)
            sent.destroy()
    finally:
        blocks.unpersist()
    kinds = f"{subject} {df.schema[subject].dataType.simpleString()}, component int, {channel} {df.schema[channel].dataType.simpleString()}, weight double"
    cast = df.schema[subject].dataType.simpleString()
    un, mix = [], []
    for key, (_, white, w, _, _) in state.items():
        whole = w @ white
        back = np.linalg.pinv(whole)
        own = [(i, c) for i in range(len(whole)) for c in range(count[key])]
        un += [(key, i, names[key][c], float(whole[i, c])) for i, c in own]
        mix += [(key, i, names[key][c], float(back[c, i])) for i, c in own]
    table = lambda rows: spark.createDataFrame(rows, kinds.replace(f"{subject} {cast}", f"{subject} string", 1)).withColumn(subject, F.col(subject).cast(cast))
    return table(un), table(mix)


def remove(samples: DataFrame, unmixing: DataFrame, mixing: DataFrame, sheet: DataFrame, subject: str, index: str, channel: str, value: str) -> DataFrame:
    """(subject, index, channel, value) without the components that ``sheet`` (subject, component) names: also of recordings that
    the weights weren't fitted on, if they have the channels. Recordings without such components stay as they are; where a
    channel lacks a sample at a place, so do all of its recording that a removed component reaches."""
    bad = sheet.select(subject, "component").distinct()
    into = mixing.join(bad, [subject, "component"]).select(subject, "component", F.col(channel).alias("__to"), F.col("weight").alias("__m"))
    operator = into.join(unmixing, [subject, "component"]).groupBy(subject, "__to", channel).agg(F.sum(F.col("__m") * F.col("weight")).alias("__w"))
    have = samples.where(~F.isnan(value) & F.col(value).isNotNull())
    most = operator.groupBy(subject, "__to").agg(F.count(F.lit(1)).alias("__all"))
    taken = have.join(operator, [subject, channel]).groupBy(subject, index, "__to").agg(F.sum(F.col(value) * F.col("__w")).alias("__v"), F.count(F.lit(1)).alias("__n"))
    taken = taken.join(most, [subject, "__to"]).select(subject, index, F.col("__to").alias(channel), F.when(F.col("__n") == F.col("__all"), F.col("__v")).alias("__v"), F.lit(True).alias("__hit"))
    cleaned = samples.join(taken, [subject, index, channel], "left")
    return cleaned.select(subject, index, channel, F.when(F.col("__hit"), F.col(value) - F.col("__v")).otherwise(F.col(value)).alias(value))
