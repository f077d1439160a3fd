import json
import math
import os
import re
import statistics
import subprocess
import sys

import pytest
from oracle import SF, compare

from epochlake.operators import reports
from jobs import group_report, session_ledger
from jobs.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_job_equals_its_sql(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    compare(spark, QUERIES[name], ORACLE_SQL[name])
    assert {k: spark.conf.get(k, None) for k in before} == before


def ledger(rows, config):
    """Sessions of (session, turn, speaker, text) by plain Python."""
    sessions = {}
    for row in rows:
        sessions.setdefault(row[0], []).append(row)
    out = {}
    for key, own in sessions.items():
        turns = {}
        for _, turn, role, text in own:
            line = (role is not None, role or "", len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
            turns[turn] = min(turns.get(turn, line), line)
        order = [turns[t] for t in sorted(turns, key=lambda t: (t is None, t or 0))]
        codes, asked, replies = [], [], []
        for (_, role, words), (_, after, reply) in zip(order, [*order[1:], (True, "", 0)], strict=True):
            if role != config["stimulus"]:
                continue
            asked.append(words)
            if after == config["response"]:
                replies.append(reply)
                codes.append("11" if reply >= config["least_words"] else "12")
            else:
                codes.append("1*")
        mean = lambda v: statistics.fmean(v) if v else None
        sd = statistics.stdev(replies) if len(replies) > 1 else None
        valid = bool(asked) and len(replies) >= config["answered_share"] * len(asked)
        part = -1 if key is None else key // config["sessions_per_part"]
        out[key] = (part, len(own), len(order), len(asked), len(replies), sum(r < config["least_words"] for r in replies), mean(asked), mean(replies), sd, ",".join(codes), valid)
    return out


def sessions(spark, out):
    got = session_ledger.stored(spark, f"{out}/sessions", session_ledger.SESSIONS).collect()
    near = lambda x: None if x is None else float(f"{x:.9g}")
    return {r.conv_id: (r.part, r.n_lines, r.n_turns, r.n_trials, r.n_answered, r.n_short, near(r.stimulus_words), near(r.response_words), near(r.response_sd), r.outcomes, r.valid) for r in got}


def expected(rows, config):
    near = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return {k: tuple(map(near, v)) for k, v in ledger(rows, config).items()}


def files_of(out, part):
    folder = f"{out}/sessions/part={part}"
    return sorted((f, os.stat(f"{folder}/{f}").st_mtime_ns) for f in os.listdir(folder) if f.endswith(".parquet"))


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    config = session_ledger.settings() | {"sessions_per_part": 5, "files_per_batch": 1, "least_words": 3}
    logs, out, checkpoint = (str(tmp_path / x) for x in ("logs", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame(rows, session_ledger.SCHEMA).coalesce(1).write.mode("append").parquet(logs)

    talk = lambda s, n: [(s, t, ("user", "assistant")[t % 2], "word " * (t + s % 3)) for t in range(n)]
    first = [row for s in range(12) for row in talk(s, 2 + s % 4)]
    arrive(first)
    told = session_ledger.run(spark, logs, out, checkpoint, config)
    assert told == {"lines_taken": len(first), "parts_replaced": 3, "sessions": 12}
    assert sessions(spark, out) == expected(first, config)
    untouched = files_of(out, 0), files_of(out, 2)

    assert session_ledger.run(spark, logs, out, checkpoint, config) == {"lines_taken": 0, "parts_replaced": 0, "sessions": 12}

    # a new session, late lines of an old one, repeated and odd lines
    second = [*talk(20, 6), (7, 50, "user", "late"), (7, 51, "assistant", None), (7, 50, "user", "late too"), (7, None, None, "x"), (None, 1, "user", ""), (None, 1, None, "a b"), (21, 3, "system", "only")]
    arrive(second[:5])
    arrive(second[5:])
    told = session_ledger.run(spark, logs, out, checkpoint, config)
    assert told == {"lines_taken": len(second), "parts_replaced": 3, "sessions": 15}
    assert sessions(spark, out) == expected(first + second, config)
    assert (files_of(out, 0), files_of(out, 2)) == untouched

    # a run that stops after the first step is made good by the next
    third = talk(3, 9)[5:]
    arrive(third)
    assert session_ledger.take(spark, logs, out, checkpoint, config) == len(third)
    assert session_ledger.run(spark, logs, out, checkpoint, config) == {"lines_taken": 0, "parts_replaced": 1, "sessions": 15}
    assert sessions(spark, out) == expected(first + second + third, config)


def test_ledger_of_an_empty_log(spark, tmp_path):
    logs, out, checkpoint = (str(tmp_path / x) for x in ("logs", "out", "checkpoint"))
    spark.createDataFrame([], session_ledger.SCHEMA).write.parquet(logs)
    for _ in range(2):
        assert session_ledger.run(spark, logs, out, checkpoint) == {"lines_taken": 0, "parts_replaced": 0, "sessions": 0}


def test_report_keeps_tasks_apart_and_reruns(spark, tmp_path):
    events = f"{SF}/events.parquet"
    out = str(tmp_path / "out")
    config = group_report.settings()
    read = lambda name, task: sorted(map(tuple, group_report.own(spark, out, name, task).collect()), key=repr)
    group_report.run(spark, events, out, config | {"task": "001"})
    once = {name: read(name, "001") for name in group_report.TABLES}
    assert all(once.values())
    group_report.run(spark, events, out, config | {"task": "other", "gap_s": 10})
    group_report.run(spark, events, out, config | {"task": "001"})
    for name in group_report.TABLES:
        again = read(name, "001")
        assert len(again) == len(once[name])
        for a, b in zip(again, once[name], strict=True):
            assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=True))
        assert read(name, "other") and (name != "blockavg_table" or read(name, "other") != again)
    columns = [c for c in group_report.read(spark, out, "blockavg_table").columns if c != "task"]
    assert tuple(columns) == reports.BLOCKAVG


def test_report_of_odd_events(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 2, "a", float(i), '{"k": 35}') for i in range(8)]
    rows += [rows[3], (8, None, 0, "a", 1.0, '{"k": 1}'), (9, "2024-01-01 00:00:01", 0, None, 1.0, '{"k": 1}'), (10, "2024-01-01 00:00:01", 0, "a", float("nan"), '{"k": 1}'), (11, "2024-01-01 00:00:01", 0, "a", 1.0, "no json"), (12, "2024-01-01 00:00:01", 5, "a", None, None)]
    schema = "event_id long, t string, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).selectExpr("event_id", "to_timestamp_ntz(t) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events"))
    group_report.run(spark, str(tmp_path / "events"), str(tmp_path / "out"))
    found = group_report.read(spark, str(tmp_path / "out"), "blockavg_table").collect()
    # even events are HbO and of subject 0, odd ones HbR and of subject 1; channel 35 is in two regions
    assert sorted((r.subjId, r.roi, r.chromophore, r.blockIndex, r.nChannels) for r in found) == [(s, roi, c, 1, 1) for s, c in ((0, "HbO"), (1, "HbR")) for roi in ("Central", "Frontal")]
    assert all(abs(r.blockMean) < 1e-12 for r in found)
    empty = spark.read.parquet(str(tmp_path / "events")).limit(0)
    empty.write.parquet(str(tmp_path / "none"))
    group_report.run(spark, str(tmp_path / "none"), str(tmp_path / "nothing"))


def test_tables_of_a_model(spark):
    fits = spark.createDataFrame([("s1", i, "task", float(i), 0.5, 2.0 * i, 0.1) for i in (1, 2, 3)], "subjId string, measIndex int, term string, beta double, se double, t double, p double")
    channels = spark.createDataFrame([("s1", i, i, i + 1, "HbO", "Left" if i < 3 else "Right") for i in (1, 2, 3)], "subjId string, measIndex int, src int, det int, chromophore string, roi string")
    table = reports.glm_table(fits, channels, "motor")
    assert tuple(table.columns) == reports.GLM
    roi = {r.roi: r for r in reports.glm_roi_table(table).collect()}
    assert tuple(reports.glm_roi_table(table).columns) == reports.GLM_ROI
    assert (roi["Left"].nChannels, roi["Left"].meanBeta) == (2, 1.5) and math.isclose(roi["Left"].seBeta, roi["Left"].sdBeta / math.sqrt(2)) and roi["Right"].sdBeta is None


@pytest.mark.parametrize("job", ["session_ledger", "group_report"])
def test_command_line(tmp_path, job):
    given = {"session_ledger": ["--logs", f"{SF}/conversations.parquet", "--checkpoint", f"{tmp_path}/c"], "group_report": ["--events", f"{SF}/events.parquet"]}[job]
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"session_ledger": session_ledger, "group_report": group_report}[job].settings()))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--out", f"{tmp_path}/out", "--config", str(config)], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "INFO:jobs." in done.stderr and os.path.isdir(f"{tmp_path}/out")
