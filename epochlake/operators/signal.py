"""Kernels over one channel's samples, and their application to tables.

A kernel takes and returns NumPy arrays. ``per_channel`` applies one to each recording's channel, packed into an array by one
aggregation: channels are what is spread. Spectra are Fourier transforms of packed channels or segments; what sums over lags
can express is made of built-in aggregates instead.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .robust import robust_mean

Keys = Sequence[str]


def packed(df: DataFrame, keys: Keys, order: str, cols: Keys) -> DataFrame:
    """A row for each channel: ``keys``, and arrays of ``order`` and ``cols`` in that order. Missing values keep their places."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("__s"))
    return rows.select(*keys, *[F.col(f"__s.{c}").alias(c) for c in (order, *cols)])


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of arrays as doubles, NaN where a value is missing."""
    offs, flat = np.asarray(column.offsets), column.values.cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def lists(rows: Sequence[np.ndarray]) -> pa.Array:
    """Arrays of doubles as a column; NaN becomes null."""
    flat = np.concatenate([np.zeros(0), *rows])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def filled(x: np.ndarray) -> np.ndarray:
    """Missing samples by linear interpolation, beyond the first and last by these."""
    have = np.flatnonzero(np.isfinite(x))
    return np.interp(np.arange(len(x)), have, x[have])


def per_channel(df: DataFrame, keys: Keys, order: str, value: str, kernel: Callable[[np.ndarray], np.ndarray], out: str | None = None, gaps: str = "null", status: str | None = None) -> DataFrame:
    """(keys, order, value, out) with ``kernel`` applied to ``value`` in ``order``; ``out``, if not given, replaces ``value``.

    A channel with a missing sample isn't filtered, and never passed off as if it were: with gaps="null" all its results are
    null; with gaps="fill" missing samples are interpolated for the kernel and null in the result. A channel without any
    value has nulls. ``status`` names a column, if wanted, that says which: ok, filled, gap or empty.
    """
    name = out or value
    kept = packed(df, keys, order, [value])
    schema = kept.withColumns({"__out": F.col(value).cast("array<double>"), "__status": F.lit("")}).schema

    def one(x: np.ndarray) -> tuple[np.ndarray, str]:
        bad = ~np.isfinite(x)
        if bad.all():
            return np.full(len(x), np.nan), "empty"
        if not bad.any():
            return np.asarray(kernel(x), float), "ok"
        if gaps != "fill":
            return np.full(len(x), np.nan), "gap"
        return np.where(bad, np.nan, kernel(filled(x))), "filled"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [one(x) for x in arrays(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns, lists([m[0] for m in made]), pa.array([m[1] for m in made], pa.string())], names=[f.name for f in schema])

    long = kept.mapInArrow(run, schema).select(*keys, "__status", F.explode(F.arrays_zip(F.col(order), F.col(value), F.col("__out"))).alias("__r"))
    own = [F.col(f"__r.{order}").alias(order), *([F.col(f"__r.{value}").alias(value)] if name != value else []), F.col("__r.__out").alias(name)]
    return long.select(*keys, *own, *([F.col("__status").alias(status)] if status else []))


# --- filters


def butter(order: int, rate: float, lo: float | None = None, hi: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth sections (b, a): low-pass below ``hi``, high-pass above ``lo``, band-pass between. By bilinear transform."""
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    k = np.arange(1, order + 1)
    proto = np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order))
    if lo is None:
        poles, zeros, gain = warp(hi) * proto, np.zeros(0), warp(hi) ** order
    elif hi is None:
        poles, zeros, gain = warp(lo) / proto, np.zeros(order), 1.0
    else:
        w0, bw = math.sqrt(warp(lo) * warp(hi)), warp(hi) - warp(lo)
        p = proto * bw / 2
        root = np.sqrt(p * p - w0 * w0 + 0j)
        poles, zeros, gain = np.r_[p + root, p - root], np.zeros(order), bw**order
    c = 2 * rate
    zd, pd_ = (c + zeros) / (c - zeros), (c + poles) / (c - poles)
    gain = gain * np.real(np.prod(c - zeros) / np.prod(c - poles))
    zd = np.r_[zd, -np.ones(len(pd_) - len(zd))]
    up = sorted(pd_[pd_.imag > 1e-12], key=lambda z: abs(z))
    real = sorted(pd_[np.abs(pd_.imag) <= 1e-12].real)
    groups = [np.array([z, z.conj()]) for z in up] + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]
    plus, minus = list(zd[zd > 0]), list(zd[zd <= 0])
    out = []
    for g in groups:
        z = [(plus if (len(plus) >= len(minus) and plus) or not minus else minus).pop() for _ in range(min(len(g), len(plus) + len(minus)))]
        out.append((np.real(np.poly(z)) if z else np.ones(1), np.real(np.poly(g))))
    b, a = out[0]
    out[0] = (b * gain, a)
    return out


@functools.lru_cache(maxsize=64)
def _blocks(b: tuple[float, ...], a: tuple[float, ...], block: int) -> tuple[np.ndarray, ...]:
    """Matrices that take a block's input to its output, its first state to its output, its input to its last state, and its
    first state to its last."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    see = np.array([p[0] for p in powers[:block]])
    h = np.r_[b[0], see[: block - 1] @ enter]
    k = np.arange(block)
    inside = np.where(k[:, None] >= k, h[np.abs(k[:, None] - k)], 0.0)
    return inside, see, np.array([p @ enter for p in powers[:block]])[::-1].T, powers[block]


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: tuple[float, float] | None = None) -> np.ndarray:
    """Causal filter of at most second order from the state ``z``.

    In blocks: within all of them at once by one matrix product with the impulse response, and from block to block by the
    state alone, so the loop is as many steps as there are blocks.
    """
    b, a = (tuple(np.r_[v, np.zeros(3 - len(v))].tolist()) for v in (b, a))
    block = 32 if len(x) < 2048 else 256
    inside, see, keep, last = _blocks(b, a, block)
    n = -(-len(x) // block)
    u = np.pad(np.asarray(x, float), (0, n * block - len(x))).reshape(n, block).T
    y, gained = inside @ u, keep @ u
    state = np.zeros(2) if z is None else np.array(z, float)
    states = np.empty((2, n))
    for i in range(n):
        states[:, i] = state
        state = last @ state + gained[:, i]
    return (y + see @ states).T.ravel()[: len(x)]


def filtfilt(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward, so without delay, with the ends continued by reflection through their value."""
    n = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    if n < 1:
        return x.astype(float)
    y = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]].astype(float)
    for _ in range(2):
        for b, a in sections:
            b3, a3 = np.r_[b, np.zeros(3 - len(b))], np.r_[a, np.zeros(3 - len(a))]
            rest = b3.sum() / a3.sum()  # state of a constant input
            z2 = b3[2] - a3[2] * rest
            z1 = b3[1] - a3[1] * rest + z2
            y = iir(b, a, y, (z1 * y[0], z2 * y[0]))
        y = y[::-1]
    return y[n : len(y) - n]


def filtfilt_many(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """:func:`filtfilt` of each row of ``x``, all rows a step at a time."""
    n = min(x.shape[1] - 1, 3 * (2 * len(sections) + 1))
    if n < 1:
        return x.astype(float)
    y = np.concatenate([2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]], 1).T.astype(float)
    for _ in range(2):
        for b, a in sections:
            b3, a3 = np.r_[b, np.zeros(3 - len(b))], np.r_[a, np.zeros(3 - len(a))]
            rest = b3.sum() / a3.sum()  # state of a constant input
            z2 = b3[2] - a3[2] * rest
            z1, z2 = (b3[1] - a3[1] * rest + z2) * y[0], z2 * y[0]
            out = np.empty_like(y)
            for t, u in enumerate(y):
                v = out[t] = b3[0] * u + z1
                z1, z2 = b3[1] * u - a3[1] * v + z2, b3[2] * u - a3[2] * v
            y = out
        y = y[::-1]
    return y[n : len(y) - n].T


def fir(rate: float, lo: float | None, hi: float | None, taps: int, stop: bool = False) -> np.ndarray:
    """Windowed-sinc kernel of a band (or, with ``stop``, all but it), Hamming window, odd length."""
    taps += 1 - taps % 2
    n = np.arange(taps) - taps // 2
    low = lambda f: 2 * f / rate * np.sinc(2 * f / rate * n)
    unit = (n == 0).astype(float)
    h = (low(hi) if hi is not None else unit) - (low(lo) if lo is not None else 0)
    h = h * np.hamming(taps)
    if lo is None:
        h = h / h.sum()
    return unit - h if stop else h


def same(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, len(h) // 2, mode="edge"), h, "valid")


def tddr(x: np.ndarray, rate: float) -> np.ndarray:
    """Motion repair by the distribution of temporal derivatives: steps of the slow part are weighted by how far they lie from
    their robust mean, so that those of movements vanish, and summed up again to a signal of the same mean."""
    level = x.mean()
    slow = x - level if rate <= 1.0 else filtfilt(butter(3, rate, hi=0.5), x - level)
    steps = np.diff(slow)
    usual, trust = robust_mean(steps)
    path = np.append(0.0, np.cumsum(trust * (steps - usual)))
    return x - slow + path - path.mean()


#: Low-pass filter of the orthonormal wavelet with two vanishing moments.
DB2 = np.array([1 + math.sqrt(3), 3 + math.sqrt(3), 3 - math.sqrt(3), 1 - math.sqrt(3)]) / (4 * math.sqrt(2))


def wavelet_repair(x: np.ndarray, iqr: float = 1.5, levels: int | None = None, taps: np.ndarray = DB2) -> np.ndarray:
    """Undecimated wavelet details beyond ``iqr`` interquartile ranges from the quartiles of their level and block, set to 0.

    The signal less its mean is continued by reflection to a power of two and transformed at all shifts: the details of a
    level that one shift's decimated transform has are a block. So a signal that is a power of two long and shifted in a
    circle has the shifted result.
    """
    n, mean = len(x), x.mean()
    size = 1 << max(2, (n - 1).bit_length())
    a = np.pad(x - mean, (0, size - n), mode="symmetric")
    high = taps[::-1] * (-1.0) ** np.arange(len(taps))
    ahead = lambda v, h, step: sum(h[k] * np.roll(v, -k * step) for k in range(len(h)))
    behind = lambda v, h, step: sum(h[k] * np.roll(v, k * step) for k in range(len(h)))
    kept = []
    for level in range(levels or max(1, size.bit_length() - 4)):
        step = 1 << level
        a, d = ahead(a, taps, step), ahead(a, high, step)
        rows = d.reshape(-1, 2 * step)
        q1, q3 = np.percentile(rows, [25, 75], axis=0)
        far = iqr * (q3 - q1)
        kept.append(np.where((rows < q1 - far) | (rows > q3 + far), 0.0, rows).ravel())
    for level in reversed(range(len(kept))):
        a = (behind(a, taps, 1 << level) + behind(kept[level], high, 1 << level)) / 2
    return a[:n] + mean


def hilbert_power(x: np.ndarray) -> np.ndarray:
    """Squared envelope."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h)) ** 2


def morlet_power(x: np.ndarray, rate: float, freqs: Sequence[float], cycles: tuple[float, float] = (3.0, 0.5)) -> np.ndarray:
    """(frequencies, samples): power by Morlet wavelets whose cycles grow from the first number by the second, 1 being with frequency."""
    out = np.zeros((len(freqs), len(x)))
    for i, f in enumerate(freqs):
        c = cycles[0] * (1 + (1 - cycles[1]) * (f / freqs[0] - 1))
        s = c / (2 * math.pi * f)
        t = np.arange(-math.ceil(3.5 * s * rate), math.ceil(3.5 * s * rate) + 1) / rate
        w = np.exp(2j * math.pi * f * t) * np.exp(-(t**2) / (2 * s * s))
        w /= np.abs(w).sum()
        full = np.convolve(x, w, "full")
        out[i] = np.abs(full[len(w) // 2 : len(w) // 2 + len(x)]) ** 2
    return out


def wavelet_power(df: DataFrame, keys: Keys, index: str, value: str, rate: float, freqs: Sequence[float], cycles: tuple[float, float] = (3.0, 0.5)) -> DataFrame:
    """(keys, freq, index, power) of each epoch by :func:`morlet_power`. An epoch with a missing sample has null power."""
    rows = packed(df, keys, index, [value])
    freqs = [float(f) for f in freqs]
    schema = rows.select(*keys, index).withColumn("__p", F.array(F.array(F.lit(0.0)))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [morlet_power(x, rate, freqs, cycles) if np.isfinite(x).all() else np.full((len(freqs), len(x)), np.nan) for x in arrays(part.column(len(keys) + 1))]
                power = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(freqs), pa.int32()), lists([p for f in found for p in f]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys) + 1], power], names=schema.names)

    each = rows.select(*keys, index, value).mapInArrow(run, schema).select(*keys, index, F.posexplode("__p").alias("__f", "__p"))
    one = each.select(*keys, F.array(*[F.lit(f) for f in freqs])[F.col("__f")].alias("freq"), F.explode(F.arrays_zip(index, "__p")).alias("__r"))
    return one.select(*keys, "freq", F.col(f"__r.{index}").alias(index), F.col("__r.__p").alias("power"))


def ersp(df: DataFrame, keys: Keys, index: str, value: str, rate: float, freqs: Sequence[float], base: tuple[int, int], **how) -> DataFrame:
    """(keys, freq, index, db): wavelet power against its mean at the places ``base``, both ends included, in decibels."""
    power = wavelet_power(df, keys, index, value, rate, freqs, **how)
    rest = power.where(F.col(index).between(*base)).groupBy(*keys, "freq").agg(F.avg("power").alias("__b"))
    return power.join(rest, [*keys, "freq"]).select(*keys, "freq", index, (F.lit(10.0) * F.log10((F.col("power") + F.lit(1e-300)) / (F.col("__b") + F.lit(1e-300)))).alias("db"))


def binarise(x: np.ndarray, zero: float = 1e-6, apart: float = 5.0) -> np.ndarray:
    """Trigger line to 0 and 1. Samples within ``zero`` of 0, and missing ones, are 0.

    A single other level is high if there are zeros beside it, and no trigger if there are none. Of several, 2-means tell
    low from high; where these lie no further apart than ``apart`` median absolute deviations, there is no high level.
    """
    x = np.nan_to_num(np.asarray(x, float))
    on = np.abs(x) > zero
    out = np.zeros(len(x), int)
    v = x[on]
    if not len(v):
        return out
    if np.ptp(v) <= zero:
        out[on] = int(not on.all())
        return out
    lo, hi = v.min(), v.max()
    while True:
        high = v > (lo + hi) / 2
        a, b = v[~high].mean(), v[high].mean()
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    noise = np.median(np.abs(v - np.median(v)))
    if hi - lo >= max(apart * noise, zero):
        out[on] = high
    return out


def infomax(x: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Unmixing matrix of channels x samples, by the natural gradient with a switch between sub- and super-Gaussian sources."""
    x = x - x.mean(1, keepdims=True)
    val, vec = np.linalg.eigh(np.cov(x))
    keep = val > val.max() * 1e-10
    white = (vec[:, keep] / np.sqrt(val[keep])).T
    z, n = white @ x, int(keep.sum())
    w = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((n, n)))[0]
    rate = 0.1
    for _ in range(rounds):
        u = w @ z
        th = np.tanh(u)
        sign = np.sign(np.mean(1 / np.cosh(u) ** 2, 1) * np.mean(u**2, 1) - np.mean(th * u, 1))
        step = rate * (np.eye(n) - (sign[:, None] * th) @ u.T / u.shape[1] - u @ u.T / u.shape[1]) @ w
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w @ white


def drop_components(x: np.ndarray, unmix: np.ndarray, bad: Sequence[int]) -> np.ndarray:
    """Channels without the components ``bad``."""
    mix, u = np.linalg.pinv(unmix), unmix @ x
    return x - mix[:, list(bad)] @ u[list(bad)]


def spline_weights(good: np.ndarray, bad: np.ndarray, m: int = 4, terms: int = 50) -> np.ndarray:
    """Weights of good electrodes (unit vectors) that give the bad ones by spherical splines."""
    def g(x: np.ndarray) -> np.ndarray:
        out, p0, p1 = np.zeros_like(x), np.ones_like(x), x.copy()
        for n in range(1, terms + 1):
            out += (2 * n + 1) / (n * (n + 1)) ** m * p1
            p0, p1 = p1, ((2 * n + 1) * x * p1 - n * p0) / (n + 1)
        return out / (4 * math.pi)

    k = len(good)
    system = np.block([[g(np.clip(good @ good.T, -1, 1)) + 1e-8 * np.eye(k), np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    return (np.linalg.pinv(system) @ np.vstack([g(np.clip(good @ bad.T, -1, 1)), np.ones((1, len(bad)))]))[:k].T


def mix_channels(samples: DataFrame, weights: DataFrame, at: Keys, channel: str = "channel", value: str = "value") -> DataFrame:
    """New channels as weighted sums: weights (target, channel, weight), by one join and sum."""
    joined = samples.join(weights, channel)
    return joined.groupBy(*at, F.col("target").alias(channel)).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def interpolate_channels(samples: DataFrame, sites: DataFrame, bad: Sequence[object], at: Keys, channel: str = "channel", value: str = "value") -> DataFrame:
    """(at, channel, value) of the channels ``bad``, by spherical splines from the others of ``sites`` (channel, x, y, z). Sites are
    a montage, some hundred rows; where a channel lacks a sample, its part is left out."""
    rows = sites.select(channel, "x", "y", "z").collect()
    place = {r[0]: np.array(r[1:]) / np.linalg.norm(r[1:]) for r in rows}
    good = [c for c in place if c not in set(bad)]
    w = spline_weights(np.array([place[c] for c in good]), np.array([place[c] for c in bad]))
    kind = samples.schema[channel].dataType.simpleString()
    weights = samples.sparkSession.createDataFrame([(c, t, float(w[i, j])) for i, t in enumerate(bad) for j, c in enumerate(good)], f"{channel} {kind}, target {kind}, weight double")
    return mix_channels(samples, weights, at, channel, value)


# --- sums instead of kernels


def convolve(df: DataFrame, keys: Keys, order: str, value: str, kernel: Sequence[float], out: str = "convolved") -> DataFrame:
    """Causal convolution, as long as the input; samples before the first, and missing ones, are 0 and keep their places. One
    ordered pass over each recording's rows; kernels of more than 64 are applied to packed channels by Fourier transforms."""
    if len(kernel) > 64:
        h = np.asarray(kernel, float)

        def whole(x: np.ndarray) -> np.ndarray:
            n = 1 << (len(x) + len(h) - 2).bit_length()
            return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]

        zero = df.select(*keys, order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__u"))
        return df.join(per_channel(zero, keys, order, "__u", whole, out).drop("__u"), [*keys, order], "left")
    own = df.withColumn(out, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    numbered = own.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    at, schema = own.columns.index(out), own.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps = Taps(kernel)
        for batch in batches:  # in the window's order
            columns = batch.columns[:-1]
            columns[at] = pa.array(taps(columns[at].to_numpy(zero_copy_only=False), batch.columns[-1].to_numpy()), pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return numbered.mapInArrow(run, schema)


class Taps:
    """Causal convolution of samples that come in order, some at a time, each with its number from 1 in its recording."""

    def __init__(self, kernel: Sequence[float]):
        self.kernel = [float(x) for x in kernel]
        self.before = np.zeros(len(self.kernel) - 1)

    def __call__(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        m, out = len(self.before), np.zeros(len(x))
        both = np.concatenate([self.before, x])
        for k, h in enumerate(self.kernel):
            out += h * np.where(n > k, both[m - k : m - k + len(x)], 0.0)
        self.before = both[len(both) - m :]
        return out


def spectra(rows: DataFrame, keys: Keys, cols: Keys, kernel: Callable[..., list[np.ndarray]], names: Keys) -> DataFrame:
    """(keys, k, names): for each row of packed arrays ``cols``, what ``kernel`` gives at each frequency k. Rows of equal length
    are transformed together."""
    schema = rows.select(*keys, *[F.array(F.lit(0.0)).alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [arrays(part.column(len(keys) + i)) for i in range(len(cols))]
                sizes = np.array([len(x) for x in data[0]])
                out: list[list] = [[None] * len(sizes) for _ in names]
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    for i, made in enumerate(kernel(*[np.stack([x[j] for j in own]) for x in data])):
                        for j, v in zip(own, made, strict=True):
                            out[i][j] = v
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *map(lists, out)], names=[f.name for f in schema])

    found = rows.select(*keys, *cols).mapInArrow(run, schema)
    return found.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("k", "__r")).select(*keys, "k", *[F.col(f"__r.{n}").alias(n) for n in names])


def periodogram(df: DataFrame, keys: Keys, index: str, value: str, rate: float) -> DataFrame:
    """One-sided power (keys, freq, power) of each channel's demeaned samples, as many as it has, padded to a power of two. A
    missing sample counts as the mean."""

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        nfft = 1 << max(0, n - 1).bit_length()
        gone = np.isnan(x)
        mean = np.where(gone, 0, x).sum(1, keepdims=True) / np.maximum(1, (~gone).sum(1, keepdims=True))
        power = np.abs(np.fft.rfft(np.where(gone, 0, x - mean), nfft)) ** 2 / (rate * n)
        power[:, 1 : (nfft + 1) // 2] *= 2
        return [power, np.broadcast_to(np.arange(power.shape[1]) * (rate / nfft), power.shape)]

    return spectra(packed(df, keys, index, [value]), keys, [value], kernel, ["power", "freq"]).select(*keys, "freq", "power")


def segments(df: DataFrame, keys: Keys, index: str, cols: Keys, width: int, step: int) -> DataFrame:
    """(keys, seg, cols): packed samples of each overlapping segment of ``width`` that a channel has in full, without gaps. A
    sample is dealt to the segments that it stands in, so a long recording is spread over its segments."""
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - (width - 1)) / F.lit(float(step))).cast("int"))
    last = F.floor(F.col(index) / F.lit(float(step))).cast("int")
    here = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    dealt = df.where(here & (first <= last)).select(*keys, index, *cols, F.explode(F.sequence(first, last)).alias("seg"))
    return packed(dealt, [*keys, "seg"], index, cols).where(F.size(cols[0]) == width)


def hamming(width: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * math.pi * np.arange(width) / (width - 1))


def welch(df: DataFrame, keys: Keys, index: str, value: str, rate: float, width: int, nfft: int | None = None) -> DataFrame:
    """Welch's power density (keys, freq, power): Hamming window, half overlap, over each channel's own full segments."""
    nfft = nfft or max(256, 1 << (width - 1).bit_length())
    taper = hamming(width)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        power = np.abs(np.fft.rfft(x * taper, nfft)) ** 2 / (rate * float((taper**2).sum()))
        power[:, 1 : (nfft + 1) // 2] *= 2
        return [power]

    found = spectra(segments(df, keys, index, [value], width, width // 2), [*keys, "seg"], [value], kernel, ["p"])
    return found.groupBy(*keys, (F.col("k") * F.lit(rate / nfft)).alias("freq")).agg(F.avg("p").alias("power"))


def coherence(df: DataFrame, keys: Keys, index: str, x: str, y: str, rate: float, width: int, nfft: int | None = None, gaps: str = "concat", least: int = 10, **how) -> DataFrame:
    """Magnitude-squared coherence (keys, freq, coherence): sums over half-overlapping Hamming segments of the samples that
    :func:`both` keeps. With gaps="segment" only stretches without a gap are segments; keys with none, or with fewer than
    ``least`` samples, have no rows."""
    nfft = nfft or max(256, 1 << (width - 1).bit_length())
    taper = hamming(width)

    def kernel(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        u, v = np.fft.rfft(a * taper, nfft), np.fft.rfft(b * taper, nfft)
        both = u * v.conj()
        return [both.real, both.imag, np.abs(u) ** 2, np.abs(v) ** 2]

    names = ["cr", "ci", "pxx", "pyy"]
    place = "__i" if gaps == "concat" else index
    rows = both(df, keys, index, x, y, **how).where(F.col("__n") >= least).select(*keys, F.col(place).alias("__at"), "__x", "__y")
    found = spectra(segments(rows, keys, "__at", ["__x", "__y"], width, width // 2), [*keys, "seg"], ["__x", "__y"], kernel, names)
    s = found.groupBy(*keys, "k").agg(*[F.sum(n).alias(n) for n in names])
    return s.select(*keys, (F.col("k") * F.lit(rate / nfft)).alias("freq"), F.try_divide(F.expr("cr*cr + ci*ci"), F.expr("pxx*pyy")).alias("coherence"))


def numbered(df: DataFrame, keys: Keys, index: str, name: str, size: int = 1 << 16) -> DataFrame:
    """Rows numbered from 0 in the order of ``index``, a whole number: within stretches of it, after the rows of those before."""
    cut = df.withColumn("__part", F.floor(F.col(index) / F.lit(size)))
    counts = cut.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(*keys, "__part", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(index))
    return cut.join(begin, [*keys, "__part"]).withColumn(name, F.col("__b") + own - 1).drop("__part", "__b")


def both(df: DataFrame, keys: Keys, index: str, x: str, y: str, mask: str | None = None, centre: str = "none") -> DataFrame:
    """(keys, index, __x, __y, __i, __n): the samples that ``mask`` keeps at which x and y are there, with their number from 0
    among them and how many the key has. centre: "none", "demean", or "zscore", by the samples kept."""
    have = ~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull()
    own = df.where(have & F.col(mask) if mask else have).select(*keys, index, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    known = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[f(c).alias(f"{c}_{n}") for c in ("__x", "__y") for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    out = numbered(own, keys, index, "__i").join(known, list(keys))
    if centre != "none":
        scale = lambda c: F.col(f"{c}_s") + F.lit(2.220446049250313e-16) if centre == "zscore" else F.lit(1.0)
        out = out.withColumns({c: (F.col(c) - F.col(f"{c}_m")) / scale(c) for c in ("__x", "__y")})
    return out.select(*keys, index, "__x", "__y", "__i", "__n")


def xcorr(df: DataFrame, keys: Keys, index: str, x: str, y: str, most: int, gaps: str = "concat", least: int = 10, size: int = 1 << 14, **how) -> DataFrame:
    """Normalised cross-correlation (keys, lag, r) of the samples that :func:`both` keeps: sum of x at i + lag times y at i, by
    the root of both sums of squares. Samples are packed in blocks of ``size``, with ``most`` of the neighbours' on both sides;
    a block gives one row of sums.

    With gaps="concat" samples on both sides of a gap are neighbours; with "segment" they keep their places and pairs don't
    reach over one. r is null for keys with fewer than ``least`` samples, and where a side is 0.
    """
    rows = both(df, keys, index, x, y, **how)
    run = F.lit(0) if gaps == "concat" else F.col(index) - F.col("__i")
    block = lambda c: F.floor(c / F.lit(size)).cast("long")
    i = F.col("__i")
    dealt = rows.select(*keys, run.cast("long").alias("__run"), i.cast("long").alias("__i"), "__x", "__y", F.col("__n").cast("long").alias("__n"))
    dealt = dealt.withColumn("__blk", F.explode(F.sequence(block(i - F.lit(most)), block(i + F.lit(most)))))
    kept = dealt.groupBy(*keys, "__run", "__blk").agg(F.max("__n").alias("__n"), F.array_sort(F.collect_list(F.struct("__i", "__x", "__y"))).alias("__s"))
    kept = kept.select(*keys, "__blk", "__n", F.col("__s.__i").alias("__i"), F.col("__s.__x").alias("__x"), F.col("__s.__y").alias("__y"))
    names = ["__s", "__c", "__q"]
    schema = StructType([*kept.select(*keys, "__n").schema.fields, *StructType.fromDDL("__s array<double>, __c array<double>, __q array<double>").fields])

    def sums(blk: int, at: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(at.astype(np.int64) // size == blk)
        s, c = np.zeros(2 * most + 1), np.zeros(2 * most + 1)
        if not len(own):
            return s, c, np.zeros(2)
        lo, hi = own[0], own[-1] + 1  # places follow each other within a stretch
        for k in range(-most, most + 1):
            a, b = max(lo, -k), min(hi, len(u) - k)
            if b > a:
                s[k + most], c[k + most] = u[a + k : b + k] @ v[a:b], b - a
        return s, c, np.array([u[lo:hi] @ u[lo:hi], v[lo:hi] @ v[lo:hi]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            made = [sums(*r) for r in zip(batch.column(n).to_pylist(), *[arrays(batch.column(n + j)) for j in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), *[lists([m[j] for m in made]) for j in range(3)]], names=[f.name for f in schema])

    each = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c)
    found = kept.mapInArrow(work, schema).groupBy(*keys).agg(F.max("__n").alias("__n"), *[each(c, n) for c, n in zip(names, (2 * most + 1, 2 * most + 1, 2), strict=True)])
    norm = F.sqrt(F.col("__q")[0] * F.col("__q")[1])
    out = found.select(*keys, "__n", norm.alias("__norm"), F.posexplode(F.arrays_zip("__s", "__c")).alias("__k", "__r")).where("__r.__c > 0")
    return out.select(*keys, (F.col("__k") - F.lit(most)).alias("lag"), F.when(F.col("__n") >= least, F.try_divide(F.col("__r.__s"), F.col("__norm"))).alias("r"))


def motion_mask(df: DataFrame, keys: Keys, order: str, value: str, reach: int, spread: int, sd: float, amplitude: float) -> DataFrame:
    """``df`` with keep: false within ``spread`` samples of a change over up to ``reach`` samples above ``amplitude`` or ``sd``
    standard deviations of the channel's steps."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = w.rowsBetween(0, reach)
    jump = F.greatest(F.max(value).over(ahead) - F.col(value), F.col(value) - F.min(value).over(ahead))
    step = F.stddev_samp(F.col("__d")).over(Window.partitionBy(*keys))
    out = df.withColumn("__d", F.col(value) - F.lag(value).over(w)).withColumn("__bad", (jump > amplitude) | (jump > F.lit(sd) * step))
    near = F.max(F.col("__bad").cast("int")).over(w.rowsBetween(-spread, spread))
    return out.withColumn("keep", F.coalesce(near == 0, F.lit(True))).drop("__d", "__bad")
