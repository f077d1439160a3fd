"""Missing samples, unequal lengths and lines without a level: what a recording does that a test table doesn't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import alignment as al
from epochlake.operators import glm as gl
from epochlake.operators import signal as sg
from epochlake.operators import stats as st


def samples(spark, channels):
    rows = [(c, i, None if v is None else float(v)) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, idx int, value double").repartition(3)


def by_channel(df, value="value"):
    out = {}
    for r in df.orderBy("channel", "idx").collect():
        out.setdefault(r.channel, []).append(r[value])
    return out


def test_a_missing_sample_keeps_its_place_in_a_convolution(spark):
    df = samples(spark, {"a": [1, None, 2, 3], "b": [None, None], "c": [5]})
    got = by_channel(sg.convolve(df, ["channel"], "idx", "value", [1, 10, 100]), "convolved")
    assert got == {"a": [1, 10, 102, 23], "b": [0, 0], "c": [5]}


def test_channels_with_gaps_are_never_passed_off_as_filtered(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=200))
    gap = [None if i in (50, 51, 120) else v for i, v in enumerate(x)]
    df = samples(spark, {"whole": x, "gap": gap, "none": [None] * 5, "one": [3.0]})
    kernel = lambda v: sg.filtfilt(sg.butter(2, 50.0, hi=5.0), v)
    got = by_channel(sg.per_channel(df, ["channel"], "idx", "value", kernel))
    assert np.allclose(got["whole"], kernel(x)) and got["one"] == [3.0]
    assert got["gap"] == [None] * 200 and got["none"] == [None] * 5
    made = sg.per_channel(df, ["channel"], "idx", "value", kernel, out="low", gaps="fill", status="how").cache()
    want = kernel(np.interp(np.arange(200), [i for i in range(200) if i not in (50, 51, 120)], np.delete(x, [50, 51, 120])))
    low = by_channel(made, "low")["gap"]
    assert all((v is None) == (i in (50, 51, 120)) and (v is None or abs(v - want[i]) < 1e-9) for i, v in enumerate(low))
    assert by_channel(made)["gap"] == [None if v is None else float(v) for v in gap]
    assert {(r.channel, r.how) for r in made.collect()} == {("whole", "ok"), ("gap", "filled"), ("none", "empty"), ("one", "ok")}


@pytest.mark.parametrize("seed", range(5))
def test_binarise_by_levels(seed):
    rng = np.random.default_rng(seed)
    noise = 3 + rng.normal(size=1000)
    assert sg.binarise(noise).sum() == 0
    on = rng.random(1000) < 0.2
    line = np.where(on, 50.0, 1.0) + rng.normal(scale=0.01, size=1000)
    line[::7] = 0
    assert (sg.binarise(line) == (on & (np.arange(1000) % 7 != 0))).all()
    assert sg.binarise(np.array([0, 1e-9, 4, 4, np.nan, -1e-8])).tolist() == [0, 0, 1, 1, 0, 0]
    assert sg.binarise(np.full(5, 2.0)).tolist() == [0] * 5 and sg.binarise(np.zeros(0)).tolist() == []


def test_alignment_without_a_common_kind_among_the_first():
    te = np.array([10.0, 12.0, 13.5, 20.0, 21.0, 25.0, 31.0])
    ce = np.array([1, 1, 1, 1, 1, 2, 2])
    tf, cf = np.array([7.0, 8.5, 15.0, 16.0, 17.0, 20.0, 26.0]), np.array([2, 2, 2, 2, 2, 2, 2])
    found, off, how = al.align_pair(te, ce, tf, cf, 0.3, 5, 5)
    assert (how, off, found) == ("offset", 5.0, [(5, 5), (6, 6)])


def density(x, rate, width, nfft):
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(width) / (width - 1))
    k = np.arange(nfft // 2 + 1)
    parts = [x[a : a + width] * taper for a in range(0, len(x) - width + 1, width // 2)]
    f = np.array([[np.sum(p * np.exp(-2j * np.pi * j * np.arange(width) / nfft)) for j in k] for p in parts])
    return f, np.where((k == 0) | (k == nfft // 2), 1, 2) / (rate * np.sum(taper**2)), k * rate / nfft


def test_spectra_of_recordings_of_unequal_lengths(spark):
    rng = np.random.default_rng(2)
    x = {c: rng.normal(size=n) for c, n in (("a", 100), ("b", 37), ("c", 64), ("d", 5))}
    df = samples(spark, x)
    got = sg.periodogram(df, ["channel"], "idx", "value", 50.0).orderBy("channel", "freq").collect()
    for c, v in x.items():
        n, nfft = len(v), 1 << (len(v) - 1).bit_length()
        k = np.arange(nfft // 2 + 1)
        f = np.array([np.sum((v - v.mean()) * np.exp(-2j * np.pi * j * np.arange(n) / nfft)) for j in k])
        want = np.where((k == 0) | (k == nfft // 2), 1, 2) * np.abs(f) ** 2 / (50.0 * n)
        assert np.allclose([r.power for r in got if r.channel == c], want)
    got = sg.welch(df, ["channel"], "idx", "value", 50.0, 16, 32).orderBy("channel", "freq").collect()
    for c, v in x.items():
        if len(v) >= 16:
            f, scale, freq = density(v, 50.0, 16, 32)
            assert np.allclose([r.power for r in got if r.channel == c], (np.abs(f) ** 2 * scale).mean(0))
            assert np.allclose([r.freq for r in got if r.channel == c], freq)
    assert {r.channel for r in got} == {"a", "b", "c"}
    both = df.withColumn("y", F.col("value") * F.col("idx"))
    got = sg.coherence(both, ["channel"], "idx", "value", "y", 50.0, 16, 32).orderBy("channel", "freq").collect()
    for c in ("a", "b", "c"):
        u, v = (density(z, 50.0, 16, 32)[0] for z in (x[c], x[c] * np.arange(len(x[c]))))
        want = np.abs((u * v.conj()).sum(0)) ** 2 / ((np.abs(u) ** 2).sum(0) * (np.abs(v) ** 2).sum(0))
        assert np.allclose([r.coherence for r in got if r.channel == c], want)
    holed = samples(spark, {"a": [None if i == 40 else v for i, v in enumerate(x["a"])]})
    f, scale, _ = density(x["a"], 50.0, 16, 32)
    keep = [i for i, a in enumerate(range(0, 85, 8)) if not a <= 40 < a + 16]
    got = sg.welch(holed, ["channel"], "idx", "value", 50.0, 16, 32).orderBy("freq").collect()
    assert np.allclose([r.power for r in got], (np.abs(f[keep]) ** 2 * scale).mean(0))


def test_windows_find_their_own_buckets(spark):
    rng = np.random.default_rng(3)
    t, lo = rng.uniform(0, 50_000, 400), rng.uniform(0, 50_000, 60)
    hi = lo + rng.uniform(-10, 9_000, 60)
    s = spark.createDataFrame([("s", float(x)) for x in t], "subj string, t double")
    w = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(lo, hi, strict=True)], "subj string, lo double, hi double")
    got = al.range_join(s, w, ["subj"]).count()
    assert got == sum(int(((t >= a) & (t <= b)).sum()) for a, b in zip(lo, hi, strict=True))
    assert al.range_join(s, w.limit(0), ["subj"]).count() == 0


def test_arx_models_against_plain_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, plain = [], {}
    for subj in (1, 2):
        a, b = np.array([0.6, -0.2]), np.array([0.8, 0.3 * subj])
        xs, ys, runs = [], [], {}
        for seg in range(3):
            n = 40 + 10 * seg
            u = rng.normal(size=n)
            y = st.simulate(a, b, 1, u) + rng.normal(scale=0.05, size=n)
            rows += [(subj, seg, i, float(y[i]), float(u[i])) for i in range(n)]
            xs += [[y[i - 1], y[i - 2], u[i - 1], u[i - 2]] for i in range(2, n)]
            ys += y[2:].tolist()
            runs[seg] = (y, u)
        plain[subj] = np.linalg.lstsq(np.array(xs), np.array(ys), rcond=None)[0], runs
    df = spark.createDataFrame(rows, "subj int, seg int, idx int, y double, u double")
    fits = st.arx(df, ["subj"], "seg", "idx", "y", "u")
    got = {(r.subj, r.term): r.beta for r in fits.collect()}
    for subj, (beta, _) in plain.items():
        assert [got[subj, c] for c in ("y1", "y2", "u0", "u1")] == pytest.approx(beta.tolist(), rel=1e-6)
    for r in st.responses(fits, ["subj"], 2, 2, 1, 30, 0.5).collect():
        beta, _ = plain[r.subj]
        h = np.zeros(30)
        for t in range(30):
            h[t] = sum(beta[k] * h[t - 1 - k] for k in range(2) if t > k) + (beta[1 + t] if t in (1, 2) else 0)
        assert r.irf == pytest.approx(h.tolist(), abs=1e-9) and r.lag == 0.5 * np.argmax(np.abs(h))
        assert r.gain == pytest.approx((beta[2] + beta[3]) / (1 - beta[0] - beta[1]))
    for r in st.simulation_scores(df, fits, ["subj"], "seg", "idx", "y", "u", 2, 2, 1).collect():
        beta, runs = plain[r.subj]
        y, u = runs[r.seg]
        free = np.zeros(len(u))
        for t in range(len(u)):
            free[t] = sum(beta[k] * free[t - 1 - k] for k in range(2) if t > k) + sum(beta[2 + k] * u[t - 1 - k] for k in range(2) if t > k)
        assert r.n == len(y) - 2 and r.rmse == pytest.approx(np.sqrt(np.mean((y - free)[2:] ** 2))) and r.r == pytest.approx(np.corrcoef(y[2:], free[2:])[0, 1])


def test_ar_irls_of_channels_together_equals_each_alone(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(120), np.sin(np.arange(120) / 9)])
    ys = {c: x @ [1.0, c] + np.convolve(rng.normal(size=120), [1, 0.5], "same") for c in range(6)}
    rows = [(c, i, float(v), 1.0, float(x[i, 1])) for c, y in ys.items() for i, v in enumerate(y)]
    rows += [(9, i, 1.0, 1.0, 2.0) for i in range(3)] + [(10, i, None, 1.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "channel int, idx int, y double, one double, x double")
    got = {(r.channel, r.term): r for r in st.ar_irls_glm(df, ["channel"], "idx", "y", ["one", "x"], 4).collect()}
    for c, y in ys.items():
        beta, cov, dof, used = st.ar_irls(y, x, 4)
        assert [got[c, k].beta for k in ("one", "x")] == pytest.approx(beta.tolist(), rel=1e-6)
        assert [got[c, k].se for k in ("one", "x")] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-6)
        assert got[c, "x"].ar_order == used and got[c, "x"].beta == pytest.approx(c, abs=0.7)
    assert got[9, None].status == got[10, None].status == "too few rows"


def test_ar_orders_by_one_recursion_equal_normal_equations():
    rng = np.random.default_rng(6)
    e = rng.normal(size=4000)
    v = np.zeros(4000)
    for t in range(2, 4000):
        v[t] = 0.5 * v[t - 1] - 0.3 * v[t - 2] + e[t]
    a = st.ar_fit(v[None], 6)[0]
    r = [np.sum(v[k:] * v[: 4000 - k]) for k in range(3)]
    assert a[2:].tolist() == [0] * 4 and a[:2] == pytest.approx(np.linalg.solve([[r[0], r[1]], [r[1], r[0]]], r[1:]))


def test_regressors_of_weights_and_courses(spark):
    grid = spark.createDataFrame([("s", float(t)) for t in range(40)] + [("q", float(t)) for t in range(5)], "subj string, t double")
    events = spark.createDataFrame([("s", 3.0, 2.0, 2.0, 1.0), ("s", 10.0, -1.0, None, 4.0), ("s", 20.0, None, 1.0, None)], "subj string, onset_s double, dur_s double, amp double, w double")
    u = {(r.subj, r.t): r.u for r in gl.boxcar(grid, events, ["subj"], 3.0).collect()}
    on = {3: 2.0, 4: 2.0, 10: 1.0, 11: 1.0, 12: 1.0, 20: 1.0, 21: 1.0, 22: 1.0}
    assert all(v == (on.get(t, 0) if s == "s" else 0) for (s, t), v in u.items()) and len(u) == 45
    x = {(r.subj, r.t): r.x for r in gl.informed_regressor(grid, events, ["subj"], [1.0], 3.0, "w", "x").collect()}
    z = 0.5**0.5
    assert all(v == pytest.approx((-z if t in (3, 4) else z if t in (10, 11, 12) else 0) if s == "s" else 0) for (s, t), v in x.items())
    course = spark.createDataFrame([("s", 0.0, 0.0), ("s", 10.0, 10.0)], "subj string, t double, value double")
    blocks = spark.createDataFrame([("s", 2.0, 5.0), ("s", 12.0, 13.0)], "subj string, lo double, hi double")
    v = {(r.subj, r.t): r.x for r in gl.course_regressor(grid, course, blocks, ["subj"], [1.0], "x").collect()}
    some = np.array([2.0, 3, 4, 5, 12, 13])
    assert all(y == pytest.approx(((t if t in some else 0) - some.mean()) / some.std(ddof=1) if s == "s" else 0) for (s, t), y in v.items())
    out, names = gl.design(grid, ["subj"], [], "poly", 2)
    assert names == ["intercept", "poly1", "poly2"] and {r.poly1 for r in out.where("t = 0").collect()} == {-1.0}
    assert gl.design(grid, ["subj"], ["a"], "dct", 1)[1] == ["a", "intercept", "dct01"]
    with pytest.raises(ValueError):
        gl.design(grid, ["subj"], [], "spline")
