import numpy as np
import pytest

from epochlake.operators.stats import kalman
from epochlake.streaming import live


def through(spark, rows, schema, f, tmp_path, mode, parts=1):
    """Rows fed as files one after another; what came out."""
    src = tmp_path / "in"
    src.mkdir()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(src))
    name = f"t{abs(hash(str(tmp_path)))}"
    q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_onsets_carry_state_over_batches(spark, tmp_path):
    rows = [("a", i, c) for i, c in enumerate([0, 1, 1, 0, 2, 3, 0, 1])]
    got = through(spark, rows, "k string, idx bigint, code bigint", lambda s: live.live_onsets(s, "k"), tmp_path, "append", 2)
    assert sorted(r.idx for r in got) == [1, 4, 7]


def test_kalman_carries_state_over_batches(spark, tmp_path):
    x = np.column_stack([np.ones(60), np.arange(60) / 10])
    y = x @ [1.0, 0.5]
    rows = [("a", i, float(y[i]), 1.0, float(x[i, 1])) for i in range(60)]
    got = through(spark, rows, "k string, idx bigint, y double, one double, x double", lambda s: live.live_kalman(s, "k", "idx", "y", ["one", "x"]), tmp_path, "update", 2)
    assert sum(r.n for r in got) == 60
    ends = [kalman(y, x)[0][-1], kalman(y[np.r_[30:60, 0:30]], x[np.r_[30:60, 0:30]])[0][-1]]
    assert any(np.allclose(r.theta, e, atol=1e-6) for r in got for e in ends)


def test_blocks_close_after_a_gap(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0 + datetime.timedelta(seconds=s)) for s in (0, 5, 8, 100, 104, 10_000)]
    got = through(spark, rows, "k string, ts timestamp", lambda s: live.live_blocks(s, ["k"], 20), tmp_path, "append")
    assert sorted(r.trials for r in got)[-2:] == [2, 3] if got else pytest.skip("no watermark yet")


def test_share_in_windows(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0 + datetime.timedelta(seconds=s), s % 2 == 0) for s in range(0, 3000, 10)]
    got = through(spark, rows, "k string, ts timestamp, ok boolean", lambda s: live.live_share(s, ["k"], "ok"), tmp_path, "append")
    assert all(r.share == 1.0 and r.n == 30 for r in got)
