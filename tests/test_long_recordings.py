"""Recordings cut into blocks equal whole ones; gaps in pairs of signals; motion by wavelets; scores and distances with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import blocks as bk
from epochlake.operators import epochs as ep
from epochlake.operators import signal as sg
from epochlake.operators import stats as st
from epochlake.plans import QUERIES


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(0)
    return {"long": np.cumsum(rng.normal(size=5000)), "even": rng.normal(size=100), "rest": rng.normal(size=199), "short": rng.normal(size=7), "one": np.array([3.0])}


def table(spark, recordings, extra=()):
    rows = [(c, i + 10, float(v)) for c, x in recordings.items() for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "channel string, idx int, value double").repartition(5)


def by_channel(df):
    out = {}
    for r in df.orderBy("channel", "idx").collect():
        out.setdefault(r.channel, []).append((r.idx, r.value))
    return out


GAP = [("gap", i, None if i == 50 else float(i)) for i in range(300)] + [("hole", i, float(i)) for i in range(300) if i != 50]


@pytest.mark.parametrize("sections", [sg.butter(2, 50.0, lo=1.0), sg.butter(8, 50.0, hi=20.0), sg.butter(3, 50.0, 0.5, 2.5)], ids=["high", "low", "band"])
def test_recursive_filter_of_fifty_blocks(spark, recordings, sections):
    got = by_channel(bk.filtfilt_blocks(table(spark, recordings, GAP), ["channel"], "idx", "value", sections, size=100))
    for c, x in recordings.items():
        assert [i for i, _ in got[c]] == list(range(10, 10 + len(x)))
        assert np.abs(np.array([v for _, v in got[c]]) - sg.filtfilt(sections, x)).max() < 1e-9
    assert len(got["gap"]) == 300 and len(got["hole"]) == 299 and all(v is None for c in ("gap", "hole") for _, v in got[c])


def test_blocks_of_a_filter_are_spread(spark):
    df = spark.range(50_000).select(F.lit("a").alias("channel"), F.col("id").alias("idx"), F.rand(1).alias("value"))
    rows = bk.blocked(df, ["channel"], "idx", "value", 1000)
    sizes = [len(r["__x"]) for r in rows.collect()]
    assert sizes == [1000] * 50
    assert [len(r["__x"]) for r in bk.blocked(df.where("idx < 2999"), ["channel"], "idx", "value", 1000).orderBy("__blk").collect()] == [1000, 1999]


@pytest.mark.parametrize("taps", [33, 331])
def test_finite_filter_of_blocks(spark, recordings, taps):
    h = sg.fir(50.0, 1.0, 12.0, taps)
    got = by_channel(bk.fir_blocks(table(spark, recordings, GAP), ["channel"], "idx", "value", h, out="value", size=100))
    for c, x in recordings.items():
        assert np.abs(np.array([v for _, v in got[c]]) - sg.same(x, h)).max() < 1e-9
    reach = taps // 2
    for c in ("gap", "hole"):  # only what the missing sample reaches is null, and its own place is there
        assert {i for i, v in got[c] if v is None} == set(range(max(0, 50 - reach), min(300, 51 + reach)))


@pytest.mark.parametrize("up, down", [(32, 125), (3, 2), (1, 4), (5, 5)])
def test_resampling_by_phases_equals_zeros_between_samples(spark, recordings, up, down):
    m = max(up, down)
    n = np.arange(-10 * m, 10 * m + 1)
    h = np.sinc(n / m) / m * np.kaiser(len(n), 5.0) * up
    got = by_channel(bk.resample_blocks(table(spark, recordings, GAP), ["channel"], "idx", "value", up, down, size=100))
    for c, x in recordings.items():
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        want = np.convolve(wide, h)[10 * m : 10 * m + len(wide)][::down]
        assert [i for i, _ in got[c]] == list(range(len(want)))
        assert np.abs(np.array([v for _, v in got[c]]) - want).max() < 1e-9
        assert np.allclose(bk.resample(x, up, down), want)
    assert 0 < sum(v is None for _, v in got["gap"]) < len(got["gap"])


def pairs(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for k, n in (("a", 120), ("b", 40), ("few", 9), ("flat", 30)):
        x, y, keep = rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.9
        x, y = (np.where(rng.random(n) < 0.15, np.nan, v) for v in (x, y))
        if k == "flat":
            y = np.zeros(n)
        data[k] = x, y, keep
        rows += [(k, i, None if math.isnan(p) else float(p), None if math.isnan(q) else float(q), bool(m)) for i, (p, q, m) in enumerate(zip(x, y, keep, strict=True))]
    return spark.createDataFrame(rows, "k string, idx int, x double, y double, keep boolean").repartition(4), data


@pytest.mark.parametrize("gaps", ["concat", "segment"])
def test_correlation_of_masked_signals(spark, gaps):
    df, data = pairs(spark)
    got = {(r.k, r.lag): r.r for r in sg.xcorr(df, ["k"], "idx", "x", "y", 6, gaps=gaps, mask="keep", centre="zscore").collect()}
    want = {}
    for k, (x, y, keep) in data.items():
        at = np.flatnonzero(keep & np.isfinite(x) & np.isfinite(y))
        u, v = x[at] - x[at].mean(), y[at] - y[at].mean()
        norm = math.sqrt((u @ u) * (v @ v))
        run = at - np.arange(len(at)) if gaps == "segment" else np.zeros(len(at))
        for lag in range(-6, 7):
            terms = [u[j + lag] * v[j] for j in range(len(at)) if 0 <= j + lag < len(at) and run[j + lag] == run[j]]
            if terms:
                want[k, lag] = sum(terms) / norm if len(at) >= 10 and norm > 0 else None
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], abs=1e-12) if want[x] is not None else got[x] is None for x in want)


def test_correlation_with_itself_is_one_whatever_is_missing(spark):
    df, _ = pairs(spark)
    same = df.where("k = 'a'").select("k", "idx", F.col("x").alias("x"), F.when(F.col("idx") != 17, F.col("x")).alias("y"))
    assert sg.xcorr(same, ["k"], "idx", "x", "y", 0).first().r == pytest.approx(1, abs=1e-12)


def test_rows_are_numbered_across_stretches(spark):
    df = spark.range(1000).where("id % 3 != 0").select((F.col("id") % 2).alias("k"), "id").repartition(6)
    got = sg.numbered(df, ["k"], "id", "n", size=64).collect()
    for k in (0, 1):
        assert [r.n for r in sorted((r for r in got if r.k == k), key=lambda r: r.id)] == list(range(sum(r.k == k for r in got)))


def decimated(x, levels, iqr):
    """Wavelet repair by the decimated transform of a circle."""
    taps = sg.DB2
    high = taps[::-1] * (-1.0) ** np.arange(4)
    a, kept = x.copy(), []
    for _ in range(levels):
        n = len(a)
        lo, hi = (np.array([sum(h[k] * a[(2 * i + k) % n] for k in range(4)) for i in range(n // 2)]) for h in (taps, high))
        q1, q3 = np.percentile(hi, [25, 75])
        hi[(hi < q1 - iqr * (q3 - q1)) | (hi > q3 + iqr * (q3 - q1))] = 0
        kept.append(hi)
        a = lo
    for hi in reversed(kept):
        n = 2 * len(a)
        out = np.zeros(n)
        for i in range(len(a)):
            for k in range(4):
                out[(2 * i + k) % n] += taps[k] * a[i] + high[k] * hi[i]
        a = out
    return a


def test_wavelet_repair_is_the_mean_over_all_shifts():
    rng = np.random.default_rng(3)
    x = np.sin(np.arange(64) / 5) + rng.normal(scale=0.1, size=64)
    x[20] += 9
    shifts = [np.roll(decimated(np.roll(x - x.mean(), -s), 3, 1.5), s) for s in range(8)]
    assert np.allclose(sg.wavelet_repair(x, levels=3), np.mean(shifts, 0) + x.mean())
    assert np.allclose(np.roll(sg.wavelet_repair(x), 1), sg.wavelet_repair(np.roll(x, 1)))
    assert np.allclose(sg.wavelet_repair(x[:50], iqr=1e9), x[:50])


def test_wavelet_query_equals_shifted_transforms(spark):
    from oracle import SF

    from epochlake.plans.inputs import epochs

    got, have = {}, {}
    for r in QUERIES["sg6_wavelet_repair"](spark, SF).where("trial < 3").collect():
        got.setdefault(r.trial, {})[r.idx] = r.value
    for r in epochs(spark, SF).where("trial < 3").collect():
        have.setdefault(r.trial, {})[r.idx] = r.value
    assert got.keys() == have.keys() and got
    for k, v in have.items():
        x = np.array([v[i] for i in range(64)])
        want = np.mean([np.roll(decimated(np.roll(x - x.mean(), -s), 3, 1.5), s) for s in range(8)], 0) + x.mean()
        assert np.allclose([got[k][i] for i in range(64)], want)


def test_scores_begin_anew_after_a_gap(spark):
    rng = np.random.default_rng(4)
    a, b = np.array([0.6, -0.2]), np.array([0.5, 0.3])
    u = rng.normal(size=60)
    y = st.simulate(a, b, 1, u) + rng.normal(scale=0.01, size=60)
    gone_y, gone_u = {20, 21}, {40}
    rows = [("s", 1, i, None if i in gone_y else float(y[i]), None if i in gone_u else float(u[i])) for i in range(60)] + [("s", 2, i, None, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "subj string, seg int, idx int, y double, u double")
    fits = spark.createDataFrame([("s", t, float(v)) for t, v in zip(("y1", "y2", "u0", "u1"), (*a, *b), strict=True)], "subj string, term string, beta double")
    got = {r.seg: r for r in st.simulation_scores(df, fits, ["subj"], "seg", "idx", "y", "u", 2, 2, 1).collect()}
    runs = [range(20), range(22, 40), range(41, 60)]
    free = np.concatenate([st.simulate(a, b, 1, u[list(r)])[2:] for r in runs])
    own = np.concatenate([y[list(r)][2:] for r in runs])
    assert got[1].n == len(own) and got[1].rmse == pytest.approx(np.sqrt(np.mean((own - free) ** 2))) and got[1].r == pytest.approx(np.corrcoef(own, free)[0, 1])
    assert (got[2].n, got[2].rmse, got[2].r) == (0, None, None)


def test_an_unknown_distance_fails_where_any_is_known(spark):
    rows = [(1, 1, 1, 30.0), (1, 1, 2, 30.0), (1, 2, 1, None), (1, 2, 2, None), (1, 3, 1, 46.0), (1, 3, 2, 45.0), (1, 4, 1, float("nan")), (1, 4, 2, 0.0), (2, 1, 1, None), (2, 1, 2, None)]
    df = spark.createDataFrame(rows, "run int, pair int, wl int, dist double")
    got = {(r.run, r.pair): (r.active, r.failed) for r in ep.prune(ep.distance_ok(df, ["run"], "dist"), ["run", "pair"], "wl", [F.col("distance_ok")], 2).collect()}
    assert got == {(1, 1): (True, 0), (1, 2): (False, 2), (1, 3): (False, 1), (1, 4): (False, 1), (2, 1): (True, 0)}
