"""Recordings read by many tasks, by ranges of their bytes and by channel and time."""

import io

import numpy as np
import pytest

from epochlake.sources import readers as rd


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def recording(records=1000, signals=20, per=4):
    rng = np.random.default_rng(0)
    return rd.edf_bytes([(f"c{i}", rng.integers(-30000, 30000, records * per)) for i in range(signals)], per, 2.0)


def joined(batches):
    out = {}
    for b in batches:
        for r in b.to_pylist():
            out[r["channel"], r["idx"]] = (r["t"], r["value"])
    return out


def test_ranges_of_bytes_give_every_record_once():
    data = recording()
    whole = joined(rd.edf_batches("x", data))
    parts = [joined(rd.edf_part(io.BytesIO(data), "x", at, at + len(data) // 8)) for at in range(0, len(data), len(data) // 8)]
    assert sum(map(len, parts)) == len(whole) == 80_000
    assert all(whole[k] == v for p in parts for k, v in p.items())
    assert all(min(i for _, i in p) % 4 == 0 for p in parts if p)


def test_a_channel_takes_its_own_bytes():
    data = recording()
    file = Counted(data)
    one = joined(rd.edf_part(file, "x", 0, len(data), {"c7", "absent"}))
    assert {c for c, _ in one} == {"c7"} and len(one) == 4000
    assert file.taken <= 2 * 4000 + 256 * 21
    assert one == {k: v for k, v in joined(rd.edf_batches("x", data)).items() if k[0] == "c7"}


@pytest.mark.parametrize("since, until", [(100.0, 103.9), (1999.0, np.inf), (-5.0, 1.0), (5000.0, np.inf)])
def test_times_take_their_records(since, until):
    data = recording()
    file = Counted(data)
    got = joined(rd.edf_part(file, "x", 0, len(data), None, since, until))
    want = {k: v for k, v in joined(rd.edf_batches("x", data)).items() if since // 2 * 2 <= v[0] < (until // 2 * 2 + 2 if until < np.inf else until)}
    assert got == want and file.taken <= 2 * 20 * 4 * 3 + 256 * 21


def test_the_source_reads_folders_in_parts_and_takes_filters(spark, tmp_path):
    rd.register(spark)
    for name in ("a.edf", "deep/b.EDF", "other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(recording(200, 5))
    whole = {(r.path.rsplit("/", 1)[-1], r.channel, r.idx): (r.t, r.value) for r in rd.edf_samples(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{edf,EDF}").load(str(tmp_path))).collect()}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        try:
            for path in (str(tmp_path), f"file://{tmp_path}"):
                df = spark.read.format("edf").option("path", path).option("bytes", 2000).option("filters", pushed).load()
                assert df.rdd.getNumPartitions() >= 8
                assert {(r.path.rsplit("/", 1)[-1], r.channel, r.idx): (r.t, r.value) for r in df.collect()} == whole
            some = df.where("channel in ('c1', 'c3') and t >= 10 and t < 21.5 and idx != 30")
            got = {(r.path.rsplit("/", 1)[-1], r.channel, r.idx): (r.t, r.value) for r in some.collect()}
            assert got and got == {k: v for k, v in whole.items() if k[1] in ("c1", "c3") and 10 <= v[0] < 21.5 and k[2] != 30}
        finally:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
