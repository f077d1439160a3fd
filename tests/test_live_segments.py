"""Live operators by segment give what the batch ones give, with late rows, and hold nothing of segments that ended."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import stats as st
from epochlake.operators import tables as tb
from epochlake.streaming import segments as sm

STORE = "spark.sql.streaming.stateStore.providerClass"
T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, idx bigint, ts timestamp, code bigint, y double, one double, x double"


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def rows():
    """Two keys with three segments each, a second apart within, and one row far later that moves the watermark."""
    rng = np.random.default_rng(0)
    out = []
    for k in ("a", "b"):
        at = np.concatenate([np.arange(40), 500 + np.arange(30), 2000 + np.arange(20)])
        for i, s in enumerate(at):
            x = float(rng.normal())
            out.append((k, i, T0 + datetime.timedelta(seconds=int(s)), int(rng.integers(0, 3)), 1 + 2 * x + 0.1 * float(rng.normal()), 1.0, x))
    return out


def through(spark, batches, f, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    name = "segments" + tmp_path.name.replace("-", "_")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(src))
    query = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    return spark.table(name).collect(), held


def shuffled():
    """Rows in three batches; within each, and for a few across batches, not in order."""
    rng = np.random.default_rng(1)
    own = rows()
    late = [r for r in own if r[1] in (35, 36, 60)]
    rest = [r for r in own if r not in late]
    rest.sort(key=lambda r: r[2])
    first, second, third = rest[:74], rest[74:134], rest[134:]
    second, third = second + [r for r in late if r[1] < 60], third + [r for r in late if r[1] == 60]
    end = [("z", i, T0 + datetime.timedelta(days=9 + i), 0, 0.0, 1.0, 0.0) for i in range(2)]
    return [[b[i] for i in rng.permutation(len(b))] for b in (first, second, third)] + [[e] for e in end]


def test_onsets_of_segments_equal_the_batch_ones(spark, tmp_path, store):
    got, held = through(spark, shuffled(), lambda s: sm.live_segment_onsets(s, "k", 60.0, late="30 minutes"), tmp_path)
    df = spark.createDataFrame(rows(), SCHEMA)
    blocks = tb.segment_blocks(df.withColumn("onset_s", F.unix_micros("ts") / 1e6), ["k"], 60.0)
    want = tb.onsets(blocks, ["k", "block"], "idx")
    assert sorted((r.k, r.idx, r.code) for r in got) == sorted((r.k, r.idx, r.code) for r in want.collect())
    assert held <= 6  # of the last key only, which the watermark hasn't passed


def test_parameters_of_segments_equal_the_batch_ones(spark, tmp_path, store):
    got, _ = through(spark, shuffled(), lambda s: sm.live_segment_kalman(s, "k", 60.0, "y", ["one", "x"], late="30 minutes"), tmp_path)
    parts = {}
    for r in rows():
        parts.setdefault((r[0], int((r[2] - T0).total_seconds()) // 500), []).append(r)
    want = {}
    for (k, _), own in parts.items():
        path, ahead, _ = st.kalman(np.array([r[4] for r in own]), np.array([r[5:] for r in own]))
        want[k, own[0][1]] = (len(own), path[-1], np.sqrt(np.mean((np.array([r[4] for r in own]) - ahead) ** 2)))
    mine = sorted((r for r in got if r.k != "z"), key=lambda r: (r.k, r.began))
    assert len(mine) == 6
    for r, (n, theta, rmse) in zip(mine, [want[k] for k in sorted(want)], strict=True):
        assert r.n == n and np.allclose(r.theta, theta) and r.rmse == pytest.approx(rmse)
