"""Components of long recordings, orthogonal regressors, long responses, and a study's quality table with broken runs."""

import numpy as np
import pytest
from oracle import SF

from epochlake.operators import glm as gl
from epochlake.operators import ica
from epochlake.operators import qc_summary as qs
from epochlake.operators import signal as sg
from epochlake.operators import stats as st
from epochlake.plans import QUERIES


def mixed(seed, n, sources=3):
    rng = np.random.default_rng(seed)
    s = np.vstack([np.sign(np.sin(np.arange(n) / 7)), rng.laplace(size=n), rng.uniform(-1, 1, n)])[:sources]
    s = (s - s.mean(1, keepdims=True)) / s.std(1, keepdims=True)
    return s, rng.normal(size=(sources, sources)) @ s


def test_components_of_fifty_blocks_equal_those_of_the_whole(spark):
    data = {1: mixed(1, 2000), 2: mixed(2, 500)}
    rows = [(k, i, c, float(x[c, i])) for k, (_, x) in data.items() for c in range(3) for i in range(x.shape[1])]
    rows += [(1, 5000, 0, 1.0), (1, 5001, 0, None), (3, 0, 0, 1.0)]  # places that lack a channel; a recording too short
    df = spark.createDataFrame(rows, "subj int, idx int, channel int, value double").repartition(6)
    un, mix = ica.fit(df, "subj", "idx", "channel", "value", rounds=120, block=40)
    got = {(r.subj, r.component, r.channel): r.weight for r in un.collect()}
    assert {k[0] for k in got} == {1, 2}
    for k, (s, x) in data.items():
        w = np.array([[got[k, i, c] for c in range(3)] for i in range(3)])
        assert np.allclose(w, sg.infomax(x, rounds=120), atol=1e-6)
        r = np.abs(np.corrcoef(np.vstack([w @ x, s]))[:3, 3:])
        assert (r.max(1) > 0.95).all() and len(set(r.argmax(1))) == 3
    # a component is taken from other data of the recording: shifted, with a missing sample
    sheet = spark.createDataFrame([(1, 0), (1, 2), (9, 1)], "subj int, component int")
    other = df.where("subj < 3 and idx < 50 and not (subj = 1 and idx = 7 and channel = 1)")
    clean = {(r.subj, r.idx, r.channel): r.value for r in ica.remove(other, un, mix, sheet, "subj", "idx", "channel", "value").collect()}
    x = data[1][1]
    w = np.array([[got[1, i, c] for c in range(3)] for i in range(3)])
    want = sg.drop_components(x, w, [0, 2])
    for i in range(50):
        for c in range(3):
            if i == 7:
                assert clean.get((1, 7, c)) is None
            else:
                assert clean[1, i, c] == pytest.approx(want[c, i], abs=1e-9)
            assert clean[2, i, c] == data[2][1][c, i]


def test_component_query_equals_the_kernel(spark):
    rows = QUERIES["sg17_ica"](spark, SF).where("subj = 3").collect()
    from epochlake.plans.inputs import epochs

    have = epochs(spark, SF).where("subj = 3").groupBy("bin", "idx").avg("value").collect()
    bins = sorted({r.bin for r in have})
    x = np.array([[next(r[2] for r in have if (r.bin, r.idx) == (b, i)) for i in range(64)] for b in bins])
    want = sg.drop_components(x, sg.infomax(x, rounds=20), [0])
    assert len(rows) == want.size and all(r.value == pytest.approx(want[bins.index(r.bin), r.idx], abs=1e-6) for r in rows)


def test_orthogonal_to_dependent_and_empty_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(rng.normal()), 1.0, 2.0, 0.0 if k == "zero" else float(i)) for k in ("a", "zero") for i in range(30)] + [("a", 99, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double, one double, two double, t double")
    got = {}
    for r in st.orthogonalise(df, ["k"], ["x"], ["one", "two", "t"]).orderBy("i").collect():
        got.setdefault(r.k, []).append(r.x)
    for k in ("a", "zero"):
        own = [r for r in rows if r[0] == k and r[2] is not None]
        a, y = np.array([r[3:] for r in own]), np.array([r[2] for r in own])
        assert np.allclose(got[k][:30], y - a @ np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-9)
    assert got["a"][30] is None


def test_long_responses_equal_short_ones(spark):
    rng = np.random.default_rng(1)
    x = [None if i in (3, 40) else float(v) for i, v in enumerate(rng.normal(size=200))]
    h = rng.normal(size=100)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 2.0)], "c string, i int, v double")
    got = {(r.c, r.i): r.y for r in sg.convolve(df, ["c"], "i", "v", h.tolist(), "y").collect()}
    want = np.convolve([v or 0.0 for v in x], h)[:200]
    assert [got["a", i] for i in range(200)] == pytest.approx(want.tolist(), abs=1e-9) and got["b", 0] == pytest.approx(2 * h[0])


def test_block_regressor_spans_blocks(spark):
    grid = spark.createDataFrame([("s", float(i)) for i in range(40)], "subj string, t double")
    events = spark.createDataFrame([("s", t) for t in (2.0, 4.0, 20.0)], "subj string, onset_s double")
    got = [r.x for r in gl.block_regressor(grid, events, ["subj"], [1.0], 5.0, 3.0, "x").orderBy("t").collect()]
    assert got == [1.0 if 2 <= i < 7 or 20 <= i < 23 else 0.0 for i in range(40)]


def test_a_failing_group_gives_a_row(spark):
    df = spark.createDataFrame([(k, float(i)) for k in range(4) for i in range(k + 1)], "k int, v double")

    def kernel(pdf):
        if len(pdf) == 2:
            raise ValueError("two rows")
        return pdf.assign(twice=pdf["v"] * 2)[["v", "twice"]]

    got = sorted((r.k, r.v, r.twice, r.error) for r in qs.attempt(df, ["k"], kernel, "v double, twice double").collect() if r.k < 3)
    assert got == [(0, 0.0, 0.0, None), (1, None, None, "ValueError: two rows"), (2, 0.0, 0.0, None), (2, 1.0, 2.0, None), (2, 2.0, 4.0, None)]


def test_one_broken_run_of_ten_leaves_the_others_as_they_are(spark):
    rng = np.random.default_rng(2)
    runs = [("s", i, "f", "o", None) for i in range(10)]
    channels = [("s", i, 2 * p + w, p, 0, 760 + 90 * w, 30.0) for i in range(10) for p in range(4) for w in range(2)]
    samples = [("s", i, c, k * 0.5, float(5 + 0.1 * rng.normal() + np.sin(k))) for i in range(10) for c in range(8) for k in range(80)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = lambda r, c, s: (make(r, "sub string, run int, inFile string, outMat string, error string"), make(c, "sub string, run int, channel int, src int, det int, wl int, dist double"), make(s, "sub string, run int, channel int, t double, value double"))
    mask = make([("s", i, c, k % 5 > 0) for i in range(10) for c in range(8) for k in range(80)], "sub string, run int, channel int, keep boolean")

    def summary(r, c, s):
        r, c, s = frames(r, c, s)
        return {x.run: x for x in qs.qc_summary(r, c, s, cardiac=s, mask=mask).collect()}

    whole = summary(runs, channels, samples)
    assert tuple(whole[0].asDict()) == tuple(qs.COLUMNS) and len(qs.COLUMNS) == 34
    assert all(r.nMeasTotal == r.nMeasActive == 8 and r.motionFrac == pytest.approx(0.2) and r.note == "" and r.sciWlPair == "wl760-wl850" for r in whole.values())
    assert all(len(r.sciMedByPair.split()) == 4 and r.ppfUsed == "6 6" and not r.flag_lowActive for r in whole.values())
    broken = {
        "reader": ([r if r[1] != 4 else (*r[:4], "OSError: truncated") for r in runs], channels, samples, "ERROR: OSError: truncated"),
        "samples": (runs, channels, [s for s in samples if s[1] != 4], "ERROR: no samples"),
        "channels": (runs, [c for c in channels if c[1] != 4], samples, "ERROR: no channels"),
        "wavelength": (runs, [c if c[1] != 4 else (*c[:5], 760, c[6]) for c in channels], samples, "ERROR: fewer than two wavelengths"),
        "dark": (runs, channels, [s if s[1] != 4 or s[2] != 0 or s[3] > 1 else (*s[:4], 0.0) for s in samples], "[nonPositiveIntensity] [nonPositiveSevere->skip]"),
    }
    for r, c, s, note in broken.values():
        got = summary(r, c, s)
        assert got[4].note == note and got[4].nMeasActive is None
        assert {k: v for k, v in got.items() if k != 4} == {k: v for k, v in whole.items() if k != 4}
