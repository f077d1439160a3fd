"""Queries take their whole table."""

import datetime

from epochlake.plans import QUERIES


def test_events_of_every_subject_are_aligned(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(s * 100 + k, s, ["view", "click", "error"][k % 3], start + datetime.timedelta(seconds=k * k + s), 1.0) for s in (3, 59, 60, 1400) for k in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["jn8_align_events"](spark, str(tmp_path)).groupBy("subj").count().collect()
    assert {r.subj for r in got} == {3, 59, 60, 1400} and all(r["count"] > 20 for r in got)
