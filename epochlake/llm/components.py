"""Connected components of links, distributed: each round joins tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links between ``a`` and ``b``, for nodes that are not least themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def shrink(links: DataFrame, least: int = 100_000) -> DataFrame:
    """Links (a, b) that connect the same, no more than one a node and block of ``least`` links or more in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= least:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node that links reach.

    A round gives each node the least label among its own and its neighbours', then each label its own label, which
    halves long chains. Both are joins of stored tables, so a node with very many links is split over tasks. It ends
    when no label changes.
    """
    scratch = Scratch(links.sparkSession, name)
    few = shrink(links)
    both = scratch.keep(few.select(F.col("a").alias("u"), F.col("b").alias("v")).union(few.select("b", "a")).distinct(), "links")
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")), "labels-0")
    for n in range(1, rounds + 1):
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = scratch.keep(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), f"step-{n}")
        to = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = scratch.keep(step.join(to, "component", "left").select("node", "was", F.coalesce("to", "component").alias("component")), f"labels-{n}")
        scratch.drop(f"step-{n}")
        if labels.where("was != component").limit(1).count() == 0:
            break
        labels = labels.select("node", "component")
    else:
        raise RuntimeError("labels still change after the last round")
    return labels.select("node", "component")
