import math

import numpy as np
import pytest

from epochlake.operators import alignment as al
from epochlake.operators import blocks as bk
from epochlake.operators import signal as sg
from epochlake.operators import stats as st
from epochlake.operators import subspace as sp
from epochlake.sources import readers as rd


def response(sections, f, rate):
    z = np.exp(-2j * math.pi * f / rate)
    return np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in sections])


@pytest.mark.parametrize(("order", "lo", "hi"), [(2, 1.0, None), (8, None, 20.0), (3, 0.5, 2.5), (3, None, 10.0), (5, 3.0, None)])
def test_butterworth_response(order, lo, hi):
    s = sg.butter(order, 100.0, lo, hi)
    for edge in filter(None, (lo, hi)):
        assert abs(response(s, edge, 100.0)) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    inside = math.sqrt(lo * hi) if lo and hi else 45.0 if lo else 0.01
    assert abs(response(s, inside, 100.0)) == pytest.approx(1.0, abs=5e-3)
    assert abs(response(s, 0.001 if lo else 49.0, 100.0)) < 1e-3


def test_blocked_filter_equals_the_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    for b, a in sg.butter(3, 100.0, 0.5, 2.5):
        y, z1, z2 = [], 0.3, -0.2
        b3, a3 = np.r_[b, np.zeros(3 - len(b))], np.r_[a, np.zeros(3 - len(a))]
        for v in x:
            o = b3[0] * v + z1
            z1, z2 = b3[1] * v - a3[1] * o + z2, b3[2] * v - a3[2] * o
            y.append(o)
        assert np.allclose(sg.iir(b, a, x, (0.3, -0.2)), y, atol=1e-10)


def test_filtfilt_keeps_phase_and_constants():
    t = np.arange(2000) / 100
    s = sg.butter(2, 100.0, hi=10.0)
    y = sg.filtfilt(s, np.sin(2 * math.pi * t) + 3)
    assert np.allclose(y, np.sin(2 * math.pi * t) + 3, atol=1e-2)
    assert np.allclose(sg.filtfilt(s, np.full(50, 7.0)), 7.0)


def test_tddr_removes_a_step():
    t = np.arange(3000) / 10
    clean = np.sin(2 * math.pi * 0.05 * t)
    moved = clean + np.where(t > 150, 8.0, 0.0)
    fixed = sg.tddr(moved, 10.0)
    assert np.corrcoef(fixed, clean)[0, 1] > 0.9 > 0.5 > np.corrcoef(moved, clean)[0, 1]


def test_wavelet_repair_keeps_smooth_parts():
    x = np.sin(np.arange(512) / 40)
    spiky = x.copy()
    spiky[100] += 20
    assert abs(sg.wavelet_repair(spiky) - x).max() < abs(spiky - x).max() / 2


def test_resample_keeps_a_slow_wave():
    x = np.sin(2 * math.pi * 3 * np.arange(2000) / 1000)
    y = bk.resample(x, 32, 125)
    assert len(y) == 512
    assert np.allclose(y[50:-50], np.sin(2 * math.pi * 3 * np.arange(512) / 256)[50:-50], atol=2e-2)


def test_morlet_and_hilbert_find_power():
    t = np.arange(1000) / 100
    x = np.sin(2 * math.pi * 10 * t)
    p = sg.morlet_power(x, 100.0, [5.0, 10.0, 20.0])[:, 300:700].mean(1)
    assert p.argmax() == 1
    assert np.allclose(sg.hilbert_power(x)[100:-100], 1, atol=1e-2)


def test_binarise_and_constant_lines():
    assert sg.binarise(np.array([0, 0, 5.0, 5.1, 0, 1.0, 1.1, 1.0, 1.05, 1.0])).tolist() == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    # levels as frequent as each other lie within five of their own median deviations: no distinct high level
    assert sg.binarise(np.array([0, 0, 5.0, 5.1, 0, 1.0, 1.1])).tolist() == [0] * 7
    assert sg.binarise(np.zeros(4)).tolist() == [0] * 4


def test_infomax_separates():
    rng = np.random.default_rng(1)
    s = np.vstack([rng.laplace(size=5000), rng.uniform(-1, 1, 5000)])
    u = sg.infomax(np.array([[1, 0.6], [0.4, 1]]) @ s, 600)  @ (np.array([[1, 0.6], [0.4, 1]]) @ s)
    c = np.abs(np.corrcoef(np.vstack([u, s]))[:2, 2:])
    assert c.max(1).min() > 0.97


def test_spline_weights_reproduce_constants():
    rng = np.random.default_rng(2)
    e = rng.normal(size=(12, 3))
    e /= np.linalg.norm(e, axis=1)[:, None]
    assert np.allclose(sg.spline_weights(e[:10], e[10:]).sum(1), 1, atol=1e-6)


def test_t_distribution():
    t = np.array([0.0, 0.01, 0.5, 1.0, 3.0, 40.0])
    exact = {1: 1 - 2 / math.pi * np.arctan(t), 2: 1 - t / np.sqrt(2 + t * t), 4: 1 - t * (t * t + 6) / (t * t + 4) ** 1.5}
    angle = np.arctan(t / math.sqrt(3))
    exact[3] = 1 - 2 / math.pi * (angle + np.sin(angle) * np.cos(angle))
    for v, p in exact.items():
        assert st.two_sided_p(t, np.full(6, v)) == pytest.approx(p, rel=1e-7, abs=1e-15)
        assert st.two_sided_p(-t, np.full(6, v)) == pytest.approx(p, rel=1e-7, abs=1e-15)
    wide = np.linspace(1e-9, 60, 400_001)  # by quadrature
    for v in (10, 37):
        density = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + wide**2 / v) ** (-(v + 1) / 2)
        below = np.trapezoid(np.where(wide <= 2, density, 0), wide)
        assert st.two_sided_p(np.array([2.0]), np.array([v]))[0] == pytest.approx(1 - 2 * below, abs=1e-4)
    assert 0 < st.two_sided_p(np.array([40.0]), np.array([200]))[0] < 1e-90
    assert np.isnan(st.two_sided_p(np.array([1.0]), np.array([0]))[0])


def test_ar_irls_is_close_under_outliers():
    rng = np.random.default_rng(3)
    n = 600
    x = np.column_stack([np.ones(n), np.sin(np.arange(n) / 7)])
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.6 * e[i - 1] + rng.normal(scale=0.2)
    e[::50] += 15
    beta, cov, dof, order = st.ar_irls(x @ [1.0, 2.0] + e, x, 5)
    assert np.allclose(beta, [1, 2], atol=0.25)
    assert dof > 0 and order >= 0 and np.all(np.diag(cov) > 0)


def test_impulse_response_and_kalman():
    r = st.impulse_response(np.array([0.5]), np.array([1.0]), 1, 20, 0.1)
    assert r["irf"][1:4].tolist() == [1.0, 0.5, 0.25] and r["gain"] == 2.0
    assert np.allclose(st.simulate(np.array([0.5]), np.array([1.0]), 1, np.r_[1.0, np.zeros(5)])[1:4], [1, 0.5, 0.25])
    x = np.column_stack([np.ones(300), np.arange(300) / 100])
    path, ahead, state = st.kalman(x @ [1.0, -2.0], x, lam=1.0, q=0.0)
    assert np.allclose(path[-1], [1, -2], atol=1e-2)
    a = st.kalman(x[:100] @ [1.0, -2.0], x[:100])
    b = st.kalman(x[100:] @ [1.0, -2.0], x[100:], state=a[2])
    assert np.allclose(b[0][-1], st.kalman(x @ [1.0, -2.0], x)[0][-1])


def whole(y, u, order=2, rows=10):
    rows_of = sp.windows(np.arange(len(y)), y, u, rows, 0, len(y))
    return sp.solved(sp.factor(rows_of), len(rows_of), order)


def test_subspace_finds_the_system():
    rng = np.random.default_rng(6)
    u = rng.normal(size=600)
    y = st.simulate(np.array([1.2, -0.5]), np.array([0.7, 0.2]), 1, u)
    a, b, c, d = whole(y, u)
    assert sorted(np.abs(np.linalg.eigvals(a))) == pytest.approx([math.sqrt(0.5)] * 2, rel=1e-6)
    assert c @ np.linalg.solve(np.eye(2) - a, b) + d == pytest.approx(0.9 / 0.3, rel=1e-6)
    with pytest.raises(ValueError):
        whole(y[:20], u[:20])


def test_align_pair():
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(1, 3, 40))
    c = rng.integers(1, 3, 40)
    te, ce = np.delete(t, [3, 20]) + 7.25, np.delete(c, [3, 20])
    found, off, how = al.align_pair(te, ce, t, c, 0.3, 5, 5)
    assert how == "offset" and off == pytest.approx(7.25) and len(found) == 38
    assert al.align_pair(t + 2, c, t, c, 0.3, 5, 5)[1:] == (pytest.approx(2.0), "place")
    assert al.align_pair(t[:3], c[:3], t[:2], c[:2], 0.3, 5, 5)[2] == "short"


def edf(signals, rate, seconds):
    n = len(signals)
    cells = [("label", 16, [f"ch{i}" for i in range(n)]), ("t", 80, [""] * n), ("unit", 8, ["uV"] * n), ("pmin", 8, ["-100"] * n), ("pmax", 8, ["100"] * n), ("dmin", 8, ["-32768"] * n), ("dmax", 8, ["32767"] * n), ("f", 80, [""] * n), ("samples", 8, [str(rate)] * n), ("r", 32, [""] * n)]
    head = "".join(x.ljust(w) for x, w in (("0", 8), ("", 80), ("", 80), ("01.01.24", 8), ("00.00.00", 8), (str(256 * (n + 1)), 8), ("", 44), (str(seconds), 8), ("1", 8), (str(n), 4)))
    head += "".join(v.ljust(w) for _, w, vs in cells for v in vs)
    raw = b"".join(np.round((s[r * rate : (r + 1) * rate] + 100) / 200 * 65535 - 32768).astype("<i2").tobytes() for r in range(seconds) for s in signals)
    return head.encode("latin-1") + raw


def test_edf(spark, tmp_path):
    s = [np.sin(np.arange(300) / 9) * 50, np.cos(np.arange(300) / 5) * 20]
    (tmp_path / "a.edf").write_bytes(edf(s, 100, 3))
    rd.register(spark)
    for df in (spark.read.format("edf").option("path", str(tmp_path)).load(), rd.edf_samples(spark.read.format("binaryFile").load(str(tmp_path)))):
        got = df.orderBy("channel", "idx").collect()
        assert len(got) == 600 and got[1].t == pytest.approx(0.01)
        assert np.allclose([r["value"] for r in got[:300]], s[0], atol=0.01)


def test_parsers():
    assert rd.parse_bins("bin 1\nstd\n.{1;2}\n\nbin 2\nodd\n.{3}") == [(1, 1, "std"), (2, 1, "std"), (3, 2, "odd")]
    assert rd.parse_equations("nch1 = ch1 - ( (ch70 + ch71)/2 ) Label X")["nch1"] == {"ch1": 1.0, "ch70": -0.5, "ch71": -0.5}


def test_write_table(spark, tmp_path):
    df = spark.createDataFrame([("sub-1", 1.0), ("sub-2", 2.0)], "subject string, value double")
    for fmt in ("parquet", "csv"):
        rd.write_table(df, str(tmp_path / fmt), ["subject"], fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).where("subject = 'sub-2'").count() == 1


def test_read_table(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "sub-1_task-audi_x.csv").write_text("subjId,beta\na,1.5\nb,NaN\n")
    schema = T.StructType([T.StructField("subjId", T.StringType()), T.StructField("beta", T.DoubleType()), T.StructField("task", T.StringType())])
    df = rd.read_table(spark, str(tmp_path), schema, ["subjId", "beta"])
    assert sorted(map(tuple, df.select("subjId", "beta", "task").collect())) == [("a", 1.5, "audi"), ("b", None, "audi")]
    with pytest.raises(ValueError, match="no column"):
        rd.read_table(spark, str(tmp_path), schema, ["t"])


def test_montage_and_difference_segments(spark):
    from epochlake.operators import tables as tb

    channels = spark.createDataFrame([(1, " fz"), (2, "CZ"), (3, "none")], "ch int, label string")
    sites = spark.createDataFrame([("Fz", 0.5, 1.0), ("fz ", 0.25, 9.0), ("Cz", 0.0, 0.0)], "label string, x double, y double")
    assert sorted(map(tuple, tb.montage(channels, sites).collect())) == [(1, "FZ", 0.25, 9.0), (2, "CZ", 0.0, 0.0)]
    rows = [("s", "odd", 0, 5.0), ("s", "odd", 1, 7.0), ("s", "common", 0, 1.0), ("s", "common", 0, 3.0), ("t", "odd", 0, 1.0)]
    df = spark.createDataFrame(rows, "subj string, kind string, idx int, value double")
    got = tb.difference_segments(df, "kind", "odd", "common", ["idx"], within=["subj"]).collect()
    assert [(r.subj, r.idx, r.value) for r in got] == [("s", 0, 3.0)]
