"""Queries that SQL can't express, held against plain loops over the same samples."""

import math
import statistics

import pytest
from oracle import SF

from epochlake.operators import signal as sg
from epochlake.plans import QUERIES
from epochlake.plans.inputs import epochs


def trials(df, few=6):
    out = {}
    for r in df.where(f"trial < {few}").collect():
        out.setdefault(r.trial, {})[r.idx] = r.value
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def both_ways(sections, x):
    """Sample by sample, ends continued by reflection, from the state of a constant input."""
    n = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    y = [2 * x[0] - x[i] for i in range(n, 0, -1)] + list(x) + [2 * x[-1] - x[-1 - i] for i in range(1, n + 1)]
    for _ in range(2):
        for b, a in sections:
            b, a = [*b, *[0.0] * (3 - len(b))], [*a, *[0.0] * (3 - len(a))]
            level = y[0] * sum(b) / sum(a)
            z2 = b[2] * y[0] - a[2] * level
            z1 = b[1] * y[0] - a[1] * level + z2
            out = []
            for v in y:
                w = b[0] * v + z1
                z1, z2 = b[1] * v - a[1] * w + z2, b[2] * v - a[2] * w
                out.append(w)
            y = out
        y = y[::-1]
    return y[n : len(y) - n]


def repaired(x, rate):
    level = statistics.fmean(x)
    slow = both_ways(sg.butter(3, rate, hi=0.5), [v - level for v in x])
    steps = [b - a for a, b in zip(slow, slow[1:], strict=False)]
    weights, mean = [1.0] * len(steps), math.inf
    for _ in range(50):
        last, mean = mean, sum(w * s for w, s in zip(weights, steps, strict=True)) / sum(weights)
        far = [s - mean for s in steps]
        scale = 4.685 * 1.4826 * statistics.median(map(abs, far))
        weights = [max(0.0, 1 - (d / scale) ** 2) ** 2 for d in far]
        if abs(mean - last) < math.sqrt(2.220446049250313e-16) * max(abs(mean), abs(last)):
            break
    path = [0.0]
    for w, s in zip(weights, steps, strict=True):
        path.append(path[-1] + w * (s - mean))
    centre = statistics.fmean(path)
    return [v - s + p - centre for v, s, p in zip(x, slow, path, strict=True)]


def test_motion_repair(spark):
    got, have = trials(QUERIES["sg5_tddr"](spark, SF)), trials(epochs(spark, SF))
    assert got.keys() == have.keys() and got
    for k, x in have.items():
        assert got[k] == pytest.approx(repaired(x, 50.0), abs=1e-9)


def levels(x):
    on = [v for v in x if abs(v) > 1e-6]
    lo, hi = min(on), max(on)
    while True:
        a = statistics.fmean(v for v in on if v <= (lo + hi) / 2)
        b = statistics.fmean(v for v in on if v > (lo + hi) / 2)
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    middle = statistics.median(on)
    apart = hi - lo >= max(5 * statistics.median(abs(v - middle) for v in on), 1e-6)
    return [float(apart and abs(v) > 1e-6 and v > (lo + hi) / 2) for v in x]


def test_binarised_triggers(spark):
    got, have = trials(QUERIES["sg16_binarise"](spark, SF), 60), trials(epochs(spark, SF), 60)
    assert got.keys() == have.keys() and got
    assert all(got[k] == levels(x) for k, x in have.items())
