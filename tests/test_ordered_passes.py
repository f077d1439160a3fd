"""Regressors in one ordered pass, and checks of channels in parts of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import epochs as ep
from epochlake.operators import glm as gl
from epochlake.operators import signal as sg


def test_regressors_over_borders_of_batches_without_joins(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = np.random.default_rng(6)
    events = [(s, float(rng.uniform(0, 60)), float(d) if d else None, float(a) if a else None) for s in (1, 2) for d, a in ((0, 2), (9, 0), (3, 1), (25, 4))]
    events += [(None, 1.0, 5.0, 1.0), (1, None, 5.0, 1.0), (3, 40.0, 5.0, float("nan")), (9, 1.0, 2.0, 1.0)]
    grid = [(s, float(t)) for s in (1, 2, 3, None) for t in range(70)]
    h = [0.0, 1.0, 0.5, 0.25]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = gl.regressor(spark.createDataFrame(grid, "s int, t double"), spark.createDataFrame(events, "s int, onset_s double, dur_s double, amp double"), ["s"], h, 3.0, "x")
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.s, r.t): r.x for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(grid)
    for s in (1, 2, 3, None):
        u = [sum((a or 1.0) for k, lo, d, a in events if k == s is not None and lo is not None and lo <= t < lo + (d or 3.0)) for t in range(70)]
        want = [sum(h[k] * u[t - k] for k in range(4) if t >= k) for t in range(70)]
        assert [got[s, float(t)] for t in range(70)] == pytest.approx(want, nan_ok=True)


def test_convolution_over_borders_of_batches_holds_no_frame(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(c, i, None if i == 4 else float(i * c + 1)) for c in range(5) for i in range(c * 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = sg.convolve(spark.createDataFrame(rows, "c int, i int, v double"), ["c"], "i", "v", [1.0, 10.0, 100.0], "y")
        assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.c, r.i): r.y for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in range(1, 5):
        own = [v or 0.0 for k, _, v in rows if k == c]
        assert [got[c, i] for i in range(c * 6)] == pytest.approx(np.convolve(own, [1, 10, 100])[: c * 6])


def test_distances_are_checked_in_parts_by_the_number_of_channels(spark, monkeypatch):
    monkeypatch.setattr(ep, "ROWS", 10)
    df = spark.createDataFrame([(r, p, w, 10.0 * r if r % 3 else None) for r in range(30) for p in range(4) for w in (1, 2)], "run int, pair int, wl int, dist double")
    made = ep.prune(ep.distance_ok(df, ["run"], "dist"), ["run", "pair"], "wl", [F.col("distance_ok")], 2)
    assert made.rdd.getNumPartitions() == 24
    got = {(r.run, r.pair): (r.active, r.failed) for r in made.collect()}
    assert got == {(r, p): ((True, 0) if r % 3 == 0 or r <= 4 else (False, 2)) for r in range(30) for p in range(4)}
