"""Steps that took more rows, or work, than they need."""

import numpy as np
import pytest

from epochlake.operators import blocks as bk
from epochlake.operators import signal as sg
from epochlake.operators import tables as tb


def test_short_channels_are_filtered_without_joins(spark):
    sections = sg.butter(3, 50.0, 0.5, 2.5)
    rng = np.random.default_rng(1)
    x = {c: rng.normal(size=64 if c < 12 else 40 + c) for c in range(16)}
    rows = [(c, i, float(v)) for c, s in x.items() for i, v in enumerate(s) if (c, i) != (3, 7)]
    df = spark.createDataFrame(rows, "c int, i int, value double")
    made = bk.filtfilt_blocks(df, ["c"], "i", "value", sections)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.c, r.i): r.value for r in made.collect()}
    for c, s in x.items():
        want = [None] * len(s) if c == 3 else sg.filtfilt(sections, s)
        assert [got[c, i] for i in range(len(s)) if (c, i) != (3, 7)] == pytest.approx([w for i, w in enumerate(want) if (c, i) != (3, 7)], abs=1e-9)


def test_cross_correlation_over_borders_of_blocks_without_pairs_as_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 50))
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, i int, x double, y double")
    made = sg.xcorr(df, ["k"], "i", "x", "y", 5, size=8)
    want = {k: sum(x[j + k] * y[j] for j in range(50) if 0 <= j + k < 50) / np.sqrt((x @ x) * (y @ y)) for k in range(-5, 6)}
    assert {r.lag: r.r for r in made.collect()} == pytest.approx(want)
    assert "lag#" not in made._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]


@pytest.mark.parametrize("slices", [1, 3, 1024])
def test_nearest_rank_orders_one_slice_alone(spark, slices):
    rng = np.random.default_rng(4)
    own = {k: sorted(np.round(rng.exponential(size=n), 2).tolist()) for k, n in ((None, 1), (1, 7), (2, 400))}
    df = spark.createDataFrame([(k, v) for k, s in own.items() for v in s], "k int, v double").union(spark.createDataFrame([(1, None)], "k int, v double"))
    for share in (0.01, 0.5, 0.99):
        got = {r.k: r.quantile for r in tb.nearest_rank(df, ["k"], "v", share, slices).collect()}
        assert got == {k: s[max(1, int(np.floor(len(s) * share + 0.5))) - 1] for k, s in own.items()}
    plan = tb.nearest_rank(df, ["k"], "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
