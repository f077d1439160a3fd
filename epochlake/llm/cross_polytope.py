"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the signed axis that it
then lies nearest to, and several hashes name a bucket of a table. Each vector also goes to the buckets that it nearly
fell into. Vectors that share a bucket are compared by their cosine in double precision.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import Scratch

COSINE = 0.95
#: Vectors that a bucket should have on average, from which the number of hashes of a table follows.
FILL = 64
#: Members of a bucket that a task compares at once; larger buckets are compared in blocks of this size.
BLOCK = 512
#: Alternatives of each hash that probes combine.
DEEP = 4


def plan(n: int, dim: int) -> tuple[int, int, int]:
    """(hashes, tables, probes): for ``n`` vectors of ``dim`` components. Hashes grow with the logarithm of ``n``; tables and
    probes with hashes, so that a pair with a cosine of 0.95 is missed in fewer than 1 in 1000 cases (simulated at 64)."""
    wide = 2 * max(2, 1 << (max(1, dim) - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(1, n) / FILL, wide))) if n > FILL else 1
    return hashes, hashes + 2, 2 * hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length, a power of two, in length * log(length) steps."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """(vectors, tables, probes) numbers of buckets, the nearest first, of unit vectors ``x``."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    out = np.empty((n, tables, probes), np.int64)
    deep = min(DEEP, 2 * d)
    ways = np.array(list(itertools.product(range(deep), repeat=hashes)))
    ways = ways[np.argsort(ways.sum(1), kind="stable")][: max(64, 4 * probes)]
    for t in range(tables):
        signs = np.random.Generator(np.random.PCG64([dim, t])).choice([-1.0, 1.0], (hashes, 3, d))
        axes, gaps = [], []
        for k in range(hashes):
            y = wide
            for r in range(3):
                y = hadamard(y * signs[k, r])
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :deep]
            near = np.take_along_axis(size, best, 1)
            axes.append(2 * best + (np.take_along_axis(y, best, 1) > 0))
            gaps.append(near[:, :1] ** 2 - near**2)
        cost = sum(gaps[k][:, ways[:, k]] for k in range(hashes))
        code = sum(axes[k][:, ways[:, k]] * (2 * d) ** k for k in range(hashes))
        first = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(code, first, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def units(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def linked(x: np.ndarray, codes: np.ndarray, table: int, bucket: int, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, new) of pairs of rows with a cosine of ``least`` or more, across sides if there are two; new: the pair shares no
    bucket of an earlier table and none with a smaller number of this one, so here is where it counts."""
    if side is None:
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(x[a] @ x[b].T >= least)
        i, j = a[i], b[j]
    new = np.arange(len(i))
    for t in range(table + 1):
        if not len(new):
            break
        u, v = codes[i[new], t], codes[j[new], t]
        same = u[:, :, None] == v[:, None, :]
        if t == table:
            same &= (u < bucket)[:, :, None]
        new = new[~same.any((1, 2))]
    fresh = np.zeros(len(i), bool)
    fresh[new] = True
    return i, j, fresh


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = COSINE, fill: int = FILL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Linked are two vectors of equal length that share a bucket and have a cosine of ``least`` or more. n_links: other rows
    linked directly. component_id: the least key that links reach, the own included; kept: whether it is the own. A vector
    that is null, empty, zero or has a null or non-finite component links with nothing. Equal vectors are one node from the
    start, counted by how many they are. Rows that repeat a key are vectors of their own. A null key's row links as others
    do; component_id is null only where all that are linked have null keys.

    Buckets with more than ``block`` vectors are compared in blocks, each pair of blocks a group of its own; only counts and
    a spanning forest leave a group, never its pairs. A pair counts in the first bucket that it shares.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for at in range(0, batch.num_rows, 1024):
                part = batch.column(1).slice(at, 1024)
                offs, flat = np.asarray(part.offsets), part.values
                bad = ~np.isfinite(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
                values = flat.cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False).astype(kind)
                for ok, a, b in zip(part.is_valid().to_pylist(), offs[:-1], offs[1:], strict=True):
                    good = ok and b > a and not bad[a:b].any() and np.linalg.norm(values[a:b].astype(np.float64)) > 0
                    out.append((values[a:b] + 0.0).astype(kind).tobytes() if good else None)  # -0 becomes 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "data"])

    rows = df.select(df[key].cast("long").alias("id"), df[vector].alias("v")).mapInArrow(pack, "id bigint, data binary")
    rows = scratch.keep(rows.select("id", "data", F.when(F.col("data").isNotNull(), F.unhex(F.md5("data"))).alias("print"), F.monotonically_increasing_id().alias("row")), "rows")
    # equal vectors by 128 bits; a node's number is that of its first row
    nodes = scratch.keep(rows.where("print is not null").groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.min("row").alias("node"), F.first("data").alias("data")), "nodes")
    about = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("data")).alias("size")).first()
    hashes, tables, probes = plan(about["n"], (about["size"] or 8) // int(kind[2]))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, n, data = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
                sizes = np.array([len(x) for x in data])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    code = buckets(units([data[i] for i in own], kind), hashes, tables, probes).astype(np.int64)
                    whole = [c.tobytes() for c in code]
                    once = np.ones(code.shape, bool)  # a bucket that a vector was given twice in a table counts once
                    for p in range(1, probes):
                        once[:, :, p] = ~(code[:, :, p : p + 1] == code[:, :, :p]).any(2)
                    i, t, p = np.nonzero(once)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), size), pa.int32()), pa.array(t, pa.int32()), pa.array(code[i, t, p]), pa.array(node[own][i]), pa.array(n[own][i]), pa.array([data[own[k]] for k in i], pa.binary()), pa.array([whole[k] for k in i], pa.binary())],
                        names=["size", "t", "bucket", "node", "n", "data", "codes"],
                    )

    entries = nodes.select("node", "n", "data").mapInArrow(sketch, "size int, t int, bucket bigint, node bigint, n bigint, data binary, codes binary")
    name = ["size", "t", "bucket"]
    filled = scratch.keep(entries.groupBy(*name).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "filled")
    large = scratch.keep(filled.where(F.col("m") > block).select(*name, F.ceil(F.col("m") / F.lit(block)).cast("int").alias("cuts")), "large")
    placed = entries.join(filled.select(*name), name, "left_semi").join(large, name, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", "t"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    group = [*name, "lo", "hi"]
    dealt = placed.select(*name, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "data", "codes")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(part: pa.RecordBatch | pa.Table) -> None:
            m = part.num_rows
            if m < 2:
                return
            t, bucket, lo, hi = (part.column(i)[0].as_py() for i in (1, 2, 3, 4))
            side = None if lo == hi else (part.column(5).to_numpy() == hi).astype(int)
            node, n = part.column(6).to_numpy(), part.column(7).to_numpy()
            codes = np.frombuffer(b"".join(part.column(9).to_pylist()), np.int64).reshape(m, tables, probes)
            i, j, new = linked(units(part.column(8).to_pylist(), kind), codes, t, bucket, side, least)
            if len(i):
                counts = np.zeros(m, np.int64)
                np.add.at(counts, i[new], n[j[new]])
                np.add.at(counts, j[new], n[i[new]])
                some = np.flatnonzero(counts)
                if len(some):
                    out.append((node[some], counts[some], np.full(len(some), 0)))
                a, b = forest(node[i], node[j])
                out.append((a, np.zeros(len(a), np.int64), b))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                a, c, b = (np.concatenate(x) for x in zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(b, mask=c > 0)], names=["node", "links", "to"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if held is not None:
                now = pa.concat_tables([held, now]).combine_chunks()
            keys = np.stack([now.column(i).to_numpy() for i in range(5)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1 if now.num_rows else np.zeros(0, np.int64)
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                settle(now.slice(a, b - a).combine_chunks().to_batches()[0])
                if len(out) > 200:
                    yield from flush()
            held = now.slice(cuts[-1] if len(cuts) else 0)
        if held is not None and held.num_rows:
            settle(held.combine_chunks().to_batches()[0])
        yield from flush()

    found = scratch.keep(dealt.mapInArrow(compare, "node bigint, links bigint, to bigint"), "found")
    links = scratch.keep(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), "links")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links, "vector-parts")
    joined = nodes.select("node", "print", "n", "least").join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    joined = scratch.keep(joined.select("node", "print", "n", "least", "part", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "joined")
    heads = scratch.keep(joined.groupBy("part").agg(F.min("least").alias("component_id")), "heads")
    named = scratch.keep(joined.join(heads, "part").select("print", "n_links", "component_id"), "named")
    out = rows.select("id", "print").join(named, "print", "left")
    component_id = F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("id"), F.lit(True)).alias("kept"))
