"""Joins in time: windows, interpolation, nearest samples, sequences of events.

A join of events with samples by a range would compare each with each. Both sides are dealt to buckets of time instead,
so it is an equality join, and a recording's rows are spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def range_join(samples: DataFrame, windows: DataFrame, keys: Keys, lo: str = "lo", hi: str = "hi", t: str = "t", closed: str = "both", bucket_s: float | None = None) -> DataFrame:
    """Samples with each window of the same keys that they lie in. ``closed``: "both", or "left" for lo <= t < hi.

    A window is dealt to the buckets that it covers, a sample to its own. ``bucket_s``, if not given, is the windows' mean
    length, which one aggregate of ``windows`` finds, so a window covers some two buckets.
    """
    if bucket_s is None:
        found = windows.where(F.col(lo) <= F.col(hi)).agg(F.avg(F.col(hi) - F.col(lo)).alias("s")).first()["s"]
        bucket_s = found if found else 1.0
    of = lambda c: F.floor(F.col(c) / F.lit(bucket_s)).cast("long")
    dealt = windows.where(F.col(lo) <= F.col(hi)).withColumn("__bucket", F.explode(F.sequence(of(lo), of(hi))))
    upper = F.col(t) <= F.col(hi) if closed == "both" else F.col(t) < F.col(hi)
    return samples.withColumn("__bucket", of(t)).join(dealt, [*keys, "__bucket"]).where((F.col(t) >= F.col(lo)) & upper).drop("__bucket")


def outside_windows(samples: DataFrame, windows: DataFrame, keys: Keys, row: Keys, **how) -> DataFrame:
    """Samples that lie in none of the windows. ``row`` names a sample."""
    inside = range_join(samples, windows, keys, **how).select(*row).distinct()
    return samples.join(inside, list(row), "left_anti")


def _neighbours(both: DataFrame, keys: Keys) -> DataFrame:
    """The last sample up to each row (a) and the first after it (b). Both are running values, one way and the other: a frame
    that ends with the partition would be worked out anew for each row."""
    up = Window.partitionBy(*keys).orderBy("__t", "__q").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__q")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("a", F.last("__p", True).over(up)).withColumn("b", F.last("__p", True).over(down))


def interpolate(samples: DataFrame, queries: DataFrame, keys: Keys, t: str = "t", value: str = "value", extrapolate: bool = False) -> DataFrame:
    """``queries`` with the linearly interpolated ``value``: null beyond the samples, or continued along the edge's slope.

    One ordered pass over the union of both: the last and the next two samples of each query are carried to it.
    """
    both = samples.select(*keys, F.col(t).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__q")).unionByName(queries.select(*keys, F.col(t).alias("__t"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q")))
    point = F.when(F.col("__q") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    out = _neighbours(both.withColumn("__p", point), keys)
    if extrapolate:  # the edge segments' other ends
        whole = Window.partitionBy(*keys)
        ends = F.sort_array(F.collect_list("p2"))
        edge = samples.select(*keys, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("p2"))
        low = edge.withColumn("__r", F.row_number().over(whole.orderBy("p2"))).where("__r <= 2").groupBy(*keys).agg(ends.alias("low"))
        high = edge.withColumn("__r", F.row_number().over(whole.orderBy(F.desc("p2")))).where("__r <= 2").groupBy(*keys).agg(ends.alias("high"))
        out = out.join(low, list(keys), "left").join(high, list(keys), "left")
        a = F.when(F.col("a").isNull(), F.col("low")[0]).when(F.col("b").isNull(), F.col("high")[0]).otherwise(F.col("a"))
        b = F.when(F.col("a").isNull(), F.get("low", F.lit(1))).when(F.col("b").isNull(), F.get("high", F.lit(1))).otherwise(F.col("b"))
        out = out.withColumn("__a", a).withColumn("b", b).withColumn("a", F.col("__a"))
    x = F.col("__t")
    line = F.col("a.v") + F.try_divide((x - F.col("a.t")) * (F.col("b.v") - F.col("a.v")), F.col("b.t") - F.col("a.t"))
    return out.where("__q = 1").select(*keys, x.alias(t), F.when(F.col("a.t") == x, F.col("a.v")).otherwise(line).alias(value))


def regrid_2d(surface: DataFrame, grid: DataFrame, keys: Keys, x: str, y: str, value: str = "value") -> DataFrame:
    """A surface on (x, y) at the points of another grid: linear along one axis, then along the other; null outside."""
    asked = surface.select(*keys, x).distinct().join(grid.select(*keys, y).distinct(), list(keys))
    rows = interpolate(surface, asked, [*keys, x], y, value)
    return interpolate(rows.where(F.col(value).isNotNull()), grid.select(*keys, x, y).distinct(), [*keys, y], x, value)


def nearest(samples: DataFrame, queries: DataFrame, keys: Keys, t: str = "t", value: str = "value") -> DataFrame:
    """``queries`` with the value of the sample nearest in time; of two as near the earlier one."""
    both = samples.select(*keys, F.col(t).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__q")).unionByName(queries.select(*keys, F.col(t).alias("__t"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q")))
    point = F.when(F.col("__q") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    out = _neighbours(both.withColumn("__p", point), keys)
    x = F.col("__t")
    closer = F.col("a").isNull() | (F.col("b.t") - x < x - F.col("a.t"))
    return out.where("__q = 1").select(*keys, x.alias(t), F.when(closer, F.col("b.v")).otherwise(F.col("a.v")).alias(value))


def block_index(events: DataFrame, keys: Keys, order: str = "onset_s", name: str = "block") -> DataFrame:
    """Events numbered from 1 in their keys by time, missing times last: before any are filtered, so gaps stay."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order))))


def positional(a: DataFrame, b: DataFrame, keys: Keys, order_a: str, order_b: str) -> DataFrame:
    """The k-th row of ``a`` with the k-th of ``b`` in the same keys, as far as both go."""
    left = block_index(a, keys, order_a, "k")
    right = block_index(b, keys, order_b, "k")
    return left.join(right, [*keys, "k"])


def merge_behaviour(trials: DataFrame, events: DataFrame, keys: Keys, order_t: str, order_e: str) -> tuple[DataFrame, DataFrame]:
    """(merged, wrong): trials and events joined by place; and subjects whose counts differ, which have no merge."""
    n_t, n_e = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((trials, "n_trials"), (events, "n_events")))
    counts = n_t.join(n_e, list(keys), "full").na.fill(0, ["n_trials", "n_events"])
    wrong = counts.where("n_trials != n_events")
    return positional(trials, events, keys, order_t, order_e).join(wrong.select(*keys), list(keys), "left_anti"), wrong


def strip_practice(events: DataFrame, keys: Keys, order: str, marker: str, prefix: Sequence[int], drop: int) -> DataFrame:
    """Events without the first ``drop`` of recordings that begin with the markers ``prefix``."""
    numbered = block_index(events, keys, order, "__k")
    match = F.count_if(F.create_map(*[F.lit(x) for kv in enumerate(prefix, 1) for x in kv])[F.col("__k")] == F.col(marker))
    practice = numbered.where(F.col("__k") <= len(prefix)).groupBy(*keys).agg(match.alias("__m")).where(F.col("__m") == len(prefix)).select(*keys)
    flagged = numbered.join(practice.withColumn("__p", F.lit(True)), list(keys), "left")
    return flagged.where(F.col("__p").isNull() | (F.col("__k") > drop)).drop("__k", "__p")


def align_pair(te: np.ndarray, ce: np.ndarray, tf: np.ndarray, cf: np.ndarray, tol: float, n_first: int, least: int) -> tuple[list[tuple[int, int]], float, str]:
    """Matches of two sequences of timed events, the offset between their clocks, and how it was found.

    Equal sequences of kinds match by place. Otherwise each pair of a kind among the first events offers an offset; where
    there is none, the first event of the second offers one with each of the first ones. That under which a walk through
    both finds most matches within the tolerance wins, the first of equals. A first sequence with fewer than ``least`` times
    matches by place as far as both go.
    """
    fe, ff = np.isfinite(te), np.isfinite(tf)
    n = min(len(te), len(tf))
    if len(te) == len(tf) and (ce == cf).all() and n:
        d = (te - tf)[fe & ff]
        return [(i, i) for i in range(n)], float(np.median(d)) if len(d) else float("nan"), "place"
    if fe.sum() < least or not ff.any():
        return [(i, i) for i in range(n)], float("nan"), "short"
    early, late = np.flatnonzero(fe[:n_first]), np.flatnonzero(ff[:n_first])
    offsets = [te[i] - tf[j] for i in early for j in late if ce[i] == cf[j]] or [te[i] - tf[np.argmax(ff)] for i in early]
    best: list[tuple[int, int]] = []
    shift = offsets[0] if offsets else float("nan")
    for off in offsets:
        a, b, found = 0, 0, []
        while a < len(te) and b < len(tf):
            gap = te[a] - (tf[b] + off)
            if not np.isfinite(gap):
                a, b = a + (not np.isfinite(te[a])), b + (not np.isfinite(tf[b]))
            elif abs(gap) <= tol and ce[a] == cf[b]:
                found.append((a, b))
                a, b = a + 1, b + 1
            elif gap < 0:
                a += 1
            else:
                b += 1
        if len(found) > len(best):
            best, shift = found, off
    return best, shift, "offset"


def align_events(a: DataFrame, b: DataFrame, key: str, tol_s: float = 0.3, n_first: int = 5, least: int = 5) -> DataFrame:
    """(key, i, j, offset, how): matched events of two recordings of a subject, by (key, onset_s, condition) of each.

    Both recordings of one subject, some thousand events, come to one task; subjects are spread.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({key: [], "i": [], "j": [], "offset": [], "how": []})
        x, y = (d.set_axis(cols, axis=1).sort_values("onset_s", kind="stable") for d in (x, y))
        found, off, how = align_pair(*(v for d in (x, y) for v in (d["onset_s"].to_numpy(float), d["condition"].to_numpy())), tol_s, n_first, least)
        return pd.DataFrame({key: [x[key].iloc[0]] * len(found), "i": [p[0] for p in found], "j": [p[1] for p in found], "offset": [off] * len(found), "how": [how] * len(found)})

    cols = [key, "onset_s", "condition"]
    schema = f"{key} {a.schema[key].dataType.simpleString()}, i int, j int, offset double, how string"
    # names of their own: both sides may come from one table
    left, right = (d.select(*cols).toDF(*[f"{side}_{c}" for c in cols]) for d, side in ((a, "a"), (b, "b")))
    return left.groupBy(f"a_{key}").cogroup(right.groupBy(f"b_{key}")).applyInPandas(run, schema)


def event_times(epochs: DataFrame, originals: DataFrame, events: DataFrame, keys: Keys, rate: float) -> DataFrame:
    """Epochs with the time of their event in seconds: by the original event, else by the event's own place.

    Latencies count samples from 1.
    """
    first = originals.select(*keys, F.col("urevent"), F.col("latency").alias("__o"))
    second = events.select(*keys, F.col("event"), F.col("latency").alias("__e"))
    joined = epochs.join(first, [*keys, "urevent"], "left").join(second, [*keys, "event"], "left")
    return joined.withColumn("event_s", (F.coalesce("__o", "__e") - 1) / F.lit(rate)).drop("__o", "__e")
