"""State-space models of one input and one output, pooled over segments, of recordings of any length.

Windows of consecutive samples are the rows of a tall, narrow matrix, of which only the triangular factor is needed. Blocks of
a recording make factors of their own windows; factors are stacked and factored again, first within a task, then for some
tasks together, then for the subject: each step passes on twice the window's width squared, whatever came in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import SIZE
from .signal import arrays

Keys = Sequence[str]
#: Shares of tasks whose factors are merged before those of a subject are.
SHARES = 64


def windows(places: np.ndarray, y: np.ndarray, u: np.ndarray, rows: int, begin: int, end: int) -> np.ndarray:
    """(windows, 2 rows): inputs, then outputs, of each window that begins at a place from ``begin`` to before ``end`` and has all
    its samples."""
    if len(places) < rows:
        return np.zeros((0, 2 * rows))
    view = lambda v: np.lib.stride_tricks.sliding_window_view(v, rows)
    first = places[: len(places) - rows + 1]
    whole = (places[rows - 1 :] - first == rows - 1) & (first >= begin) & (first < end)
    out = np.concatenate([view(u), view(y)], 1)[whole]
    return out[np.isfinite(out).all(1)]


def factor(stacked: np.ndarray) -> np.ndarray:
    """Triangular factor, as wide as it is tall."""
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((stacked.shape[1] - len(r), stacked.shape[1]))])


def solved(r: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) from the factor of ``n`` windows: A and C of the space that future outputs share once the input's is projected
    out, B and D of what that space doesn't hold."""
    rows = r.shape[1] // 2
    if n < 3 * rows:
        raise ValueError("too few samples")
    low = r.T
    left, size, _ = np.linalg.svd(low[rows:, rows:])
    gamma = left[:, :order] * np.sqrt(size[:order])
    c, a = gamma[0], np.linalg.pinv(gamma[:-1]) @ gamma[1:]
    rest = left[:, order:].T
    known = rest @ low[rows:, :rows] @ np.linalg.pinv(low[:rows, :rows])
    system = np.concatenate([np.column_stack([rest[:, j], rest[:, j + 1 :] @ gamma[: rows - j - 1]]) for j in range(rows)])
    found = np.linalg.lstsq(system, known.T.ravel(), rcond=None)[0]
    return a, found[1:], c, float(found[0])


def _merged(parts: DataFrame, keys: Keys) -> DataFrame:
    """One factor for each of ``keys``: (keys, r, n)."""
    slim = parts.select(*keys, "r", "n")

    def run(table: pa.Table) -> pa.Table:
        flat = arrays(table["r"].combine_chunks())
        side = int(math.isqrt(len(flat[0])))
        r = factor(np.concatenate(flat).reshape(-1, side)).ravel()
        return table.slice(0, 1).select(list(keys)).append_column("r", pa.array([r], pa.list_(pa.float64()))).append_column("n", pa.array([sum(table["n"].to_pylist())], pa.int64()))

    return slim.groupBy(*keys).applyInArrow(run, slim.schema)


def state_space(df: DataFrame, keys: Keys, order: str, y: str, u: str, states: int = 2, dt: float = 1.0, segment: Keys = (), rows: int = 10, size: int = SIZE) -> DataFrame:
    """(keys, gain, tau, status) of the model of each of ``keys``, pooled over its ``segment``: gain at rest, slowest time constant.

    ``order`` is a whole number: windows are of samples that follow each other by it, within a segment, without a missing one.
    A status other than ok says why there is no model.
    """
    own = [*keys, *segment]
    at = F.col(order).cast("long")
    part = lambda c: F.floor(c / F.lit(size)).cast("long")
    dealt = df.select(*own, at.alias("__i"), F.col(y).cast("double").alias("__y"), F.col(u).cast("double").alias("__u")).withColumn("__blk", F.explode(F.sequence(part(F.col("__i") - (rows - 1)), part(F.col("__i")))))
    packed = dealt.groupBy(*own, "__blk").agg(F.array_sort(F.collect_list(F.struct("__i", "__y", "__u"))).alias("s")).select(*keys, "__blk", F.col("s.__i").alias("i"), F.col("s.__y").alias("y"), F.col("s.__u").alias("u"))
    schema = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL("share int, r array<double>, n long").fields])
    arrow = to_arrow_schema(schema)
    k = len(keys)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            cols = [arrays(batch.column(k + 1 + j)) for j in range(3)]
            heads, blk = list(zip(*[batch.column(j).to_pylist() for j in range(k)], strict=True)), batch.column(k).to_pylist()
            for i in range(batch.num_rows):
                found = windows(cols[0][i].astype(np.int64), cols[1][i], cols[2][i], rows, blk[i] * size, (blk[i] + 1) * size)
                r, n = held.get(heads[i], (np.zeros((0, 2 * rows)), 0))
                held[heads[i]] = [factor(np.vstack([r, found])), n + len(found)]
            if len(held) > 1000:  # subjects come in any order; what a task has of one may go out in parts
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    def rows_of(held: dict) -> pa.RecordBatch:
        share = TaskContext.get().partitionId() % SHARES
        columns = [list(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*columns, [share] * len(held), [r.ravel() for r, _ in held.values()], [n for _, n in held.values()]], arrow, strict=True)], schema=arrow)

    out = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL("gain double, tau double, status string").fields])

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for flat, n in zip(arrays(batch.column(k)), batch.column(k + 1).to_pylist(), strict=True):
                try:
                    a, b, c, d = solved(flat.reshape(2 * rows, 2 * rows), n, states)
                    pole = float(np.abs(np.linalg.eigvals(a)).max())
                    made.append((float(c @ np.linalg.solve(np.eye(states) - a, b) + d), -dt / math.log(pole) if 0 < pole < 1 else None, "ok"))
                except (ValueError, np.linalg.LinAlgError) as e:
                    made.append((None, None, str(e)))
            columns = [pa.array([m[j] for m in made], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], names=out.names)

    parts = packed.mapInArrow(factors, schema)
    return _merged(_merged(parts, [*keys, "share"]), keys).mapInArrow(models, out)
