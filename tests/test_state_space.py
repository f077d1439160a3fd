"""State-space models of recordings in parts, and pooled over segments, equal those of the whole."""

import numpy as np
import pytest

from epochlake.operators import subspace as sp


def system(n, seed, poles=(0.9, 0.5)):
    rng = np.random.default_rng(seed)
    a, b, c, d = np.array([[poles[0], 0.3], [0.0, poles[1]]]), np.array([0.4, 1.0]), np.array([1.0, -0.5]), 0.25
    u, x, y = rng.normal(size=n), np.zeros(2), np.zeros(n)
    for t in range(n):
        y[t] = c @ x + d * u[t] + 0.01 * rng.normal()
        x = a @ x + b * u[t]
    return y, u, float(c @ np.linalg.solve(np.eye(2) - a, b) + d)


def rows(subj, seg, y, u, start=0):
    return [(subj, seg, start + i, None if np.isnan(v) else float(v), float(w)) for i, (v, w) in enumerate(zip(y, u, strict=True))]


SCHEMA = "subj int, seg int, idx int, y double, u double"


@pytest.mark.parametrize("parts", [6, 1])
def test_models_in_parts_and_of_segments(spark, parts):
    data, want = [], {}
    for subj, poles in ((1, (0.9, 0.5)), (2, (0.8, 0.2))):
        y, u, gain = system(2000, subj, poles)
        data += rows(subj, 0, y, u, -700)
        r = sp.factor(sp.windows(np.arange(2000), y, u, 10, 0, 2000))
        a, b, c, d = sp.solved(r, 1991, 2)
        want[subj] = float(c @ np.linalg.solve(np.eye(2) - a, b) + d), -0.5 / np.log(np.abs(np.linalg.eigvals(a)).max())
        assert want[subj][0] == pytest.approx(gain, rel=0.02)
        assert sorted(np.linalg.eigvals(a)) == pytest.approx(sorted(poles), abs=0.02)
    # segments of one subject, with a missing sample: windows of all of them, none across
    stacked, n = [], 0
    for seg in range(20):
        y, u, _ = system(100, 100 + seg)
        if seg == 3:
            y[40] = np.nan
        data += rows(3, seg, y, u)
        found = sp.windows(np.arange(100), y, u, 10, 0, 100)
        stacked.append(found)
        n += len(found)
    assert n == 20 * 91 - 10
    a, b, c, d = sp.solved(sp.factor(np.vstack(stacked)), n, 2)
    want[3] = float(c @ np.linalg.solve(np.eye(2) - a, b) + d), -0.5 / np.log(np.abs(np.linalg.eigvals(a)).max())
    data += rows(4, 0, *system(30, 9)[:2])
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    got = {r.subj: r for r in sp.state_space(df, ["subj"], "idx", "y", "u", 2, 0.5, ["seg"], size=100).collect()}
    for subj, (gain, tau) in want.items():
        assert got[subj].status == "ok" and got[subj].gain == pytest.approx(gain, rel=1e-6) and got[subj].tau == pytest.approx(tau, rel=1e-6)
    assert (got[4].status, got[4].gain, got[4].tau) == ("too few samples", None, None)
    whole = {r.subj: r.gain for r in sp.state_space(df.where("subj < 3"), ["subj"], "idx", "y", "u", 2, 0.5).collect()}
    assert whole == pytest.approx({k: want[k][0] for k in (1, 2)}, rel=1e-6)
