"""Design of linear models of haemodynamic responses: regressors of stimuli, weighted or following a signal, and drifts.

A grid is a table of a recording's sample times, a row each; regressors are columns of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .alignment import interpolate, range_join
from .signal import Taps, convolve
from .stats import ols
from .tables import block_table

Keys = Sequence[str]


def boxcar(grid: DataFrame, events: DataFrame, keys: Keys, stim_s: float, name: str = "u", t: str = "t", onset: str = "onset_s", dur: str | None = "dur_s", amp: str | None = "amp") -> DataFrame:
    """``grid`` with the sum of the amplitudes of the events in force: from onset on, and before onset and duration.

    A duration that is missing or not above 0 is ``stim_s``, a missing amplitude 1. Without events the sum is 0.
    """
    return _boxcar(grid, events, keys, stim_s, name, None, t, onset, dur, amp)


def _boxcar(grid: DataFrame, events: DataFrame, keys: Keys, stim_s: float, name: str, kernel: Sequence[float] | None, t: str = "t", onset: str = "onset_s", dur: str | None = "dur_s", amp: str | None = "amp") -> DataFrame:
    """:func:`boxcar`, convolved with ``kernel`` if there is one: events and samples of a recording in one ordered pass."""
    length = F.coalesce(F.when(F.col(dur) > 0, F.col(dur)), F.lit(float(stim_s))) if dur else F.lit(float(stim_s))
    size = F.coalesce(F.col(amp).cast("double"), F.lit(1.0)) if amp else F.lit(1.0)
    same = [F.col(k).cast(grid.schema[k].dataType).alias(k) for k in keys]
    windows = events.select(*same, F.col(onset).cast("double").alias("__t"), (F.col(onset) + length).cast("double").alias("__hi"), size.alias("__amp"), F.lit(0).alias("__q"))
    windows = windows.where(F.col("__t") < F.col("__hi")).dropna(subset=list(keys))
    samples = grid.withColumns({name: F.lit(0.0), "__t": F.col(t).cast("double"), "__hi": F.lit(None).cast("double"), "__amp": F.lit(None).cast("double"), "__q": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy("__t", "__q", "__hi", "__amp")
    rows = samples.unionByName(windows, allowMissingColumns=True).withColumns({"__k": F.row_number().over(w), "__n": F.sum("__q").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    schema = grid.withColumn(name, F.lit(0.0)).schema
    cols = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps = Taps(kernel) if kernel else None
        force: list[tuple[float, float]] = []  # ends and amplitudes of the last recording's events that may go on
        for batch in batches:  # in the window's order
            at, hi, size, q, k, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__t", "__hi", "__amp", "__q", "__k", "__n"))
            starts = np.append(np.flatnonzero(k == 1), len(k))
            first = int(starts[0])
            on = np.flatnonzero(q == 0)
            ends = starts[np.searchsorted(starts, on, "right")]
            todo = [(0, first, *x) for x in force] + list(zip(on.tolist(), ends.tolist(), hi[on].tolist(), size[on].tolist(), strict=True))
            force, u = [], np.zeros(len(k))
            for a, b, end, amount in todo:
                stop = a + int(at[a:b].searchsorted(end))
                u[a:stop] += amount
                if stop == b == len(k):
                    force.append((end, amount))
            keep = q == 1
            own = batch.filter(pa.array(keep))
            u = u[keep]
            made = pa.array(taps(u, n[keep]) if taps else u, pa.float64())
            yield pa.RecordBatch.from_arrays([made if c == name else own.column(c) for c in cols], names=cols)

    return rows.select(*cols, "__t", "__hi", "__amp", "__q", "__k", "__n").mapInArrow(run, schema)


def regressor(grid: DataFrame, events: DataFrame, keys: Keys, hrf: Sequence[float], stim_s: float, name: str, t: str = "t", **how) -> DataFrame:
    """``grid`` with the boxcar of the events convolved with a haemodynamic response."""
    if 0 < len(hrf) <= 64:
        return _boxcar(grid, events, keys, stim_s, name, hrf, t, **how)
    return convolve(boxcar(grid, events, keys, stim_s, "__u", t, **how), keys, t, "__u", hrf, name).drop("__u")


def block_regressor(grid: DataFrame, events: DataFrame, keys: Keys, hrf: Sequence[float], gap_s: float, stim_s: float, name: str, t: str = "t", onset: str = "onset_s") -> DataFrame:
    """As :func:`regressor`, of blocks of events without a longer gap: from a block's first onset to its last, and a stimulus."""
    blocks = block_table(events, keys, gap_s, stim_s, onset).select(*keys, F.col("onset").alias(onset), F.col("dur").alias("dur_s"))
    return regressor(grid, blocks, keys, hrf, stim_s, name, t, onset=onset, amp=None)


def informed_regressor(grid: DataFrame, events: DataFrame, keys: Keys, hrf: Sequence[float], stim_s: float, weight: str, name: str, t: str = "t", **how) -> DataFrame:
    """As :func:`regressor`, each event weighted by its z-score among the recording's valid weights; an invalid weight is 0, and
    so are all where they don't differ."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(weight).over(w)
    z = F.when(sd > 0, (F.col(weight) - F.avg(weight).over(w)) / sd)
    scored = events.withColumn("__z", F.coalesce(z, F.lit(0.0)))
    return regressor(grid, scored, keys, hrf, stim_s, name, t, amp="__z", **how)


def course_regressor(grid: DataFrame, course: DataFrame, blocks: DataFrame, keys: Keys, hrf: Sequence[float], name: str, t: str = "t", value: str = "value") -> DataFrame:
    """``grid`` with a signal's course (keys, t, value) within blocks (keys, lo, hi), interpolated to the grid and continued at its
    ends, 0 outside of them; convolved; and scored by mean and standard deviation of its samples other than 0."""
    inside = range_join(grid.select(*keys, t), blocks, keys, t=t).select(*keys, t).distinct()
    found = interpolate(course, inside, keys, t, value, extrapolate=True).withColumnRenamed(value, "__u")
    out = convolve(grid.join(found, [*keys, t], "left"), keys, t, "__u", hrf, "__c").drop("__u")
    w = Window.partitionBy(*keys)
    some = F.when(F.col("__c") != 0, F.col("__c"))
    sd = F.stddev_samp(some).over(w)
    return out.withColumn(name, (F.col("__c") - F.coalesce(F.avg(some).over(w), F.lit(0.0))) / F.when(sd > 0, sd).otherwise(1.0)).drop("__c")


def design(grid: DataFrame, keys: Keys, regressors: Keys, drift: str = "none", order: int = 0, t: str = "t") -> tuple[DataFrame, list[str]]:
    """(``grid`` with the columns of a model, their names): the regressors, an intercept, and a drift of ``order`` columns: none,
    dct (cosines over each recording's own samples) or poly (powers of time from its mean, by its largest distance)."""
    w = Window.partitionBy(*keys)
    out, names = grid.withColumn("intercept", F.lit(1.0)), [*regressors, "intercept"]
    if drift == "dct":
        place, n = F.row_number().over(w.orderBy(t)) - 1, F.count(F.lit(1)).over(w)
        out = out.withColumns({"__i": place, "__n": n})
        for k in range(1, order + 1):
            out = out.withColumn(f"dct{k:02d}", F.cos(F.lit(3.141592653589793) / F.col("__n") * (F.col("__i") + F.lit(0.5)) * F.lit(k)))
            names.append(f"dct{k:02d}")
        out = out.drop("__i", "__n")
    elif drift == "poly":
        mean = F.avg(t).over(w)
        out = out.withColumn("__m", mean).withColumn("__far", F.max(F.abs(F.col(t) - F.col("__m"))).over(w))
        for k in range(1, order + 1):
            out = out.withColumn(f"poly{k}", fn.poly_drift(F.col(t), F.col("__m"), F.col("__far"), k))
            names.append(f"poly{k}")
        out = out.drop("__m", "__far")
    elif drift != "none":
        raise ValueError(f"no drift is called {drift}")
    return out, names


def informed_glm(df: DataFrame, keys: Keys, y: str, x: Keys, needed: Keys, contrasts: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """:func:`ols` of ``y`` on ``x``, without the keys for which one of the regressors ``needed`` is 0 throughout."""
    norms = df.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in needed])
    for c in needed:
        norms = norms.where(F.col(c) > 1e-12)
    return ols(df.join(norms.select(*keys), list(keys), "left_semi"), keys, y, x, contrasts)
