"""Filters of recordings of any length: channels are cut into blocks of samples, and blocks are what is spread.

A block is a row: its channel's keys, its number, and its samples in an array. A finite kernel gets some of its neighbours'
samples with it (overlap-save), each sample dealt to the blocks that need it. A recursive filter passes a state of a few
numbers from block to block instead: blocks are filtered from rest, all at once; a scan over what each leaves behind, with the
power of the transition matrix for its length, gives the state that each begins with; then blocks are filtered from that. Only
the scan sees a whole channel, as those few numbers for each block.

Samples are placed by a whole number, their index. A missing sample is one whose value is null or whose index is absent between
the channel's first and last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .signal import arrays, filtfilt, filtfilt_many, iir, lists

Keys = Sequence[str]
Sections = Sequence[tuple[np.ndarray, np.ndarray]]
#: Samples of a block.
SIZE = 1 << 16


def extent(df: DataFrame, keys: Keys, index: str, value: str) -> DataFrame:
    """(keys, __lo, __n, __whole) of each channel: first index, samples up to the last, and whether none of them is missing."""
    out = df.groupBy(*keys).agg(F.min(index).cast("long").alias("__lo"), F.max(index).cast("long").alias("__hi"), F.count(F.when(~F.isnan(value), F.col(value))).alias("__have"))
    n = F.col("__hi") - F.col("__lo") + 1
    return out.select(*keys, "__lo", n.alias("__n"), (F.col("__have") == n).alias("__whole"))


def blocked(df: DataFrame, keys: Keys, index: str, value: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, __lo, __n, __whole, __blk, __of, __i, __x): blocks of ``size`` samples and ``before`` and ``after`` more, as far as
    the channel goes. __of: the channel's number of blocks; a rest that doesn't fill one is part of the last. __i, __x: places
    from 0 in the channel, and values, in order.

    Where channels are few, what is known of each is broadcast by Spark; where they are many, none is much of the whole.
    """
    known = df.join(extent(df, keys, index, value), list(keys))
    of = F.greatest(F.lit(1), F.floor(F.col("__n") / F.lit(size))).cast("long")
    at = F.col(index).cast("long") - F.col("__lo")
    number = lambda c: F.greatest(F.lit(0), F.least(F.col("__of") - 1, F.floor(c / F.lit(size)))).cast("long")
    rows = known.withColumn("__of", of).withColumn("__i", at)
    if before or after:
        rows = rows.withColumn("__blk", F.explode(F.sequence(number(at - F.lit(after)), number(at + F.lit(before)))))
    else:
        rows = rows.withColumn("__blk", number(at))
    own = rows.groupBy(*keys, "__blk").agg(*[F.first(c).alias(c) for c in ("__lo", "__n", "__whole", "__of")], F.array_sort(F.collect_list(F.struct("__i", F.col(value).cast("double").alias("__x")))).alias("__s"))
    return own.select(*keys, "__lo", "__n", "__whole", "__blk", "__of", F.col("__s.__i").alias("__i"), F.col("__s.__x").alias("__x"))


def _each(rows: DataFrame, added: str, kernel: Callable[[dict], dict]) -> DataFrame:
    """``rows`` with columns ``added`` (a schema), which ``kernel`` makes of each row's values, arrays as NumPy."""
    schema = to_arrow_schema(StructType.fromDDL(added))
    plain = rows.schema.names
    wide = [f.name for f in rows.schema if f.dataType.typeName() == "array"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = {c: arrays(part.column(j))[0] if c in wide else part.column(j)[0].as_py() for j, c in enumerate(plain)}
                made = kernel(row)
                new = [lists([made[f.name]]).cast(f.type) if pa.types.is_list(f.type) else pa.array([made[f.name]], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*plain, *schema.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(added).fields]))


def _long(rows: DataFrame, keys: Keys, index: str, out: str) -> DataFrame:
    """(keys, index, out): a row for each place of ``__at`` with the value of ``__y``."""
    one = rows.select(*keys, "__lo", F.explode(F.arrays_zip("__at", "__y")).alias("__r"))
    return one.select(*keys, (F.col("__r.__at").cast("long") + F.col("__lo")).alias(index), F.col("__r.__y").alias(out))


def _dense(places: np.ndarray, values: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Values at places ``begin`` to before ``end``, NaN where there is none."""
    out = np.full(end - begin, np.nan)
    places = places.astype(np.int64) - begin
    inside = (places >= 0) & (places < end - begin)
    out[places[inside]] = values[inside]
    return out


def _bounds(row: dict, size: int) -> tuple[int, int]:
    """Places of a block's own samples."""
    begin = row["__blk"] * size
    return begin, row["__n"] if row["__blk"] == row["__of"] - 1 else begin + size


# --- finite kernels


def fir_blocks(df: DataFrame, keys: Keys, index: str, value: str, kernel: Sequence[float], out: str | None = None, size: int = SIZE) -> DataFrame:
    """(keys, index, out): zero-phase filter by a symmetric kernel of odd length; ends are continued by their value. A sample
    that the kernel can't reach without a missing one is null."""
    h = np.asarray(kernel, float)
    half = len(h) // 2

    def run(row: dict) -> dict:
        begin, end = _bounds(row, size)
        lo, hi = max(0, begin - half), min(row["__n"], end + half)
        x = _dense(row["__i"], row["__x"], lo, hi)
        x = np.pad(x, (half - (begin - lo), half - (hi - end)), mode="edge")
        return {"__at": np.arange(begin, end, dtype=float), "__y": convolved(x, h)}

    return _long(_each(blocked(df, keys, index, value, size, half, half), "__at array<double>, __y array<double>", run), keys, index, out or value)


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where ``h`` lies whole within ``x``; NaN where it meets one. By Fourier transforms where ``h`` is long."""
    bad = np.isnan(x)
    if len(h) <= 64:
        return np.convolve(x, h, "valid")
    n = 1 << (len(x) + len(h) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(np.where(bad, 0, x), n) * np.fft.rfft(h, n), n)[len(h) - 1 : len(x)]
    near = np.cumsum(np.r_[0, bad])
    return np.where(near[len(h) :] - near[: -len(h)] > 0, np.nan, y)


def resampler(up: int, down: int) -> np.ndarray:
    """(phase, tap): the windowed-sinc anti-alias kernel for a rate times up/down, dealt to the phases of its outputs."""
    m = max(up, down)
    n = np.arange(-10 * m, 10 * m + 1)
    h = np.sinc(n / m) / m * np.kaiser(len(n), 5.0) * up
    reach = 10 * m // up + 1
    taps = np.zeros((up, 2 * reach + 1))
    for phase in range(up):
        at = phase + 10 * m + up * np.arange(reach, -reach - 1, -1)  # of the samples from ``reach`` before to as many after
        inside = (at >= 0) & (at < len(h))
        taps[phase, inside] = h[at[inside]]
    return taps


def resampled(x: np.ndarray, first: int, outputs: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Outputs by number, of which k lies at k * down / up samples, from samples ``x`` that begin at place ``first`` and reach as
    far as the kernel does on both sides."""
    reach = taps.shape[1] // 2
    base, phase = outputs * down // up, outputs * down % up
    windows = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1)
    y = np.empty(len(outputs))
    for at in range(0, len(outputs), 8192):
        part = slice(at, at + 8192)
        y[part] = np.einsum("nk,nk->n", windows[base[part] - reach - first], taps[phase[part]])
    return y


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """A whole channel's :func:`resampled`."""
    taps = resampler(up, down)
    reach = taps.shape[1] // 2
    return resampled(np.pad(x, (reach, reach)), -reach, np.arange(-(-len(x) * up // down)), up, down, taps)


def resample_blocks(df: DataFrame, keys: Keys, index: str, value: str, up: int, down: int, out: str | None = None, size: int = SIZE) -> DataFrame:
    """(keys, index, out) at a rate times up/down, numbered from 0: each output from the samples around it by the taps of its
    phase, so no zeros are put between samples. Beyond its ends a channel is 0. An output near a missing sample is null."""
    taps = resampler(up, down)
    reach = taps.shape[1] // 2

    def run(row: dict) -> dict:
        begin, end = _bounds(row, size)
        lo, hi = max(0, begin - reach), min(row["__n"], end + reach)
        x = np.pad(_dense(row["__i"], row["__x"], lo, hi), (reach - (begin - lo), reach - (hi - end)))
        outputs = np.arange(-(-begin * up // down), -(-end * up // down))
        return {"__at": outputs.astype(float), "__y": resampled(x, begin - reach, outputs, up, down, taps)}

    rows = _each(blocked(df, keys, index, value, size, reach, reach), "__at array<double>, __y array<double>", run)
    return _long(rows.withColumn("__lo", F.lit(0)), keys, index, out or value)


# --- recursive filters


def _sections(sections: Sections) -> list[tuple[np.ndarray, np.ndarray]]:
    wide = lambda v: np.r_[v, np.zeros(3 - len(v))]
    return [(wide(b), wide(a)) for b, a in sections]


def cascade(sections: Sections, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, state after it) of second-order sections one after the other; a state is two numbers a section."""
    state = state.copy()
    for k, (b, a) in enumerate(_sections(sections)):
        y = iir(b, a, x, (state[2 * k], state[2 * k + 1]))
        if len(x) >= 2:
            state[2 * k + 1] = b[2] * x[-1] - a[2] * y[-1]
            state[2 * k] = b[1] * x[-1] - a[1] * y[-1] + b[2] * x[-2] - a[2] * y[-2]
        elif len(x):
            z1 = state[2 * k + 1]
            state[2 * k], state[2 * k + 1] = b[1] * x[-1] - a[1] * y[-1] + z1, b[2] * x[-1] - a[2] * y[-1]
        x = y
    return x, state


def transition(sections: Sections) -> np.ndarray:
    """Matrix that takes a state to the next without input."""
    d = 2 * len(sections)
    return np.stack([cascade(sections, np.zeros(1), unit)[1] for unit in np.eye(d)], 1)


def resting(sections: Sections, x: float) -> np.ndarray:
    """State that a constant input ``x`` leaves."""
    out = []
    for b, a in _sections(sections):
        y = x * b.sum() / a.sum()
        z2 = b[2] * x - a[2] * y
        out += [b[1] * x - a[1] * y + z2, z2]
        x = y
    return np.array(out)


def _scan(rows: DataFrame, keys: Keys, sections: Sections, first: str, state: str, steps: str, last: bool) -> DataFrame:
    """(keys, __blk, __from): the state that each block begins with. ``first``: what the channel's first block begins with, of
    that block; ``state``: what a block leaves from rest; ``steps``: its number of samples. ``last``: from the last block on."""
    step = transition(sections)
    own = F.array_sort(F.collect_list(F.struct("__blk", first, state, steps)))
    kept = rows.groupBy(*keys).agg(own.alias("__s"))
    schema = StructType([*kept.select(*keys).schema.fields, *StructType.fromDDL("__blk array<long>, __from array<array<double>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                table = part.column(len(keys)).flatten()
                left, begins, counts = arrays(table.field(state)), arrays(table.field(first)), table.field(steps).to_numpy()
                powers = {int(n): np.linalg.matrix_power(step, int(n)) for n in np.unique(counts)}
                out: list[np.ndarray] = [np.zeros(0)] * len(table)
                order = range(len(table))[::-1] if last else range(len(table))
                now = begins[order[0]]
                for i in order:
                    out[i] = now
                    now = powers[int(counts[i])] @ now + left[i]
                ends = pa.array([0, len(table)], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.ListArray.from_arrays(ends, table.field("__blk")), pa.ListArray.from_arrays(ends, lists(out))], names=schema.names)

    rows = kept.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("__blk", "__from")).alias("__r"))
    return rows.select(*keys, "__r.__blk", "__r.__from")


def _alone(df: DataFrame, keys: Keys, index: str, value: str, sections: Sections, out: str) -> DataFrame:
    """:func:`filtfilt_blocks` of channels of one block each; those of equal length that come together are filtered together."""
    kept = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__x")))).alias("__s"))
    kept = kept.select(*keys, F.col("__s.__i").alias("__at"), F.col("__s.__x").alias("__y"))
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                at, x = (arrays(part.column(len(keys) + j)) for j in (0, 1))
                whole = [p[-1] - p[0] + 1 == len(p) and not np.isnan(v).any() for p, v in zip(at, x, strict=True)]
                made = [np.full(len(v), np.nan) for v in x]
                sizes = np.array([len(v) if ok else 0 for v, ok in zip(x, whole, strict=True)])
                for n in np.unique(sizes[sizes > 0]):
                    own = np.flatnonzero(sizes == n)
                    found = filtfilt_many(sections, np.stack([x[j] for j in own])) if len(own) > 8 else [filtfilt(sections, x[j]) for j in own]
                    for j, y in zip(own, found, strict=True):
                        made[j] = y
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(made)], names=names)

    rows = kept.mapInArrow(run, kept.schema).withColumn("__lo", F.lit(0).cast("long"))
    return _long(rows, keys, index, out)


def filtfilt_blocks(df: DataFrame, keys: Keys, index: str, value: str, sections: Sections, out: str | None = None, size: int = SIZE) -> DataFrame:
    """(keys, index, out): filtered forward and backward by second-order sections, with the ends continued by reflection through
    their value, as if each channel were filtered as one array. A channel with a missing sample has nulls: a recursive filter
    carries it to all others. Where no channel has two blocks, as one aggregate of ``df`` tells, channels are packed once and
    filtered whole."""
    edge = 3 * (2 * len(sections) + 1)
    size = max(size, edge + 1)
    nothing = np.zeros(2 * len(sections))

    def forward(row: dict) -> dict:
        x = row["__x"] if row["__whole"] else np.zeros(len(row["__x"]))
        n = min(row["__n"] - 1, edge)
        begin = nothing
        if row["__blk"] == 0:  # what comes before is filtered here, and after the last block too
            head = 2 * x[0] - x[n:0:-1] if n else x[:0]
            begin = cascade(sections, head, resting(sections, head[0] if n else x[0]))[1]
        return {"__first": begin, "__left": cascade(sections, x, nothing)[1], "__steps": len(x)}

    def through(row: dict) -> dict:
        x = row["__x"] if row["__whole"] else np.zeros(len(row["__x"]))
        y, state = cascade(sections, x, row["__from"])
        n = min(row["__n"] - 1, edge)
        begin = nothing
        if row["__blk"] == row["__of"] - 1:
            tail = cascade(sections, 2 * x[-1] - x[-2 : -n - 2 : -1] if n else x[:0], state)[0][::-1]
            begin = cascade(sections, tail, resting(sections, tail[0] if n else y[-1]))[1]
        return {"__y": y, "__last": begin, "__back": cascade(sections, y[::-1], nothing)[1]}

    def back(row: dict) -> dict:
        y = cascade(sections, row["__y"][::-1], row["__from"])[0][::-1]
        if row["__n"] == 1:
            y = row["__x"]
        return {"__at": row["__i"], "__out": y if row["__whole"] else np.full(len(y), np.nan)}

    longest = df.groupBy(*keys).agg((F.max(index) - F.min(index)).alias("n")).agg(F.max("n")).first()[0]
    if (longest or 0) + 1 < 2 * size:  # no channel has two blocks: each is one row from the start
        return _alone(df, keys, index, value, sections, out or value)
    on = [*keys, "__blk"]
    parts = _each(blocked(df, keys, index, value, size), "__first array<double>, __left array<double>, __steps int", forward)
    begun = parts.drop("__first", "__left").join(_scan(parts, keys, sections, "__first", "__left", "__steps", False), on)
    once = _each(begun, "__y array<double>, __last array<double>, __back array<double>", through).drop("__from")
    turned = once.drop("__last", "__back").join(_scan(once, keys, sections, "__last", "__back", "__steps", True), on)
    return _long(_each(turned, "__at array<double>, __out array<double>", back).drop("__y").withColumnRenamed("__out", "__y"), keys, index, out or value)
