"""Queries against their SQL on rows that the small tables lack."""

import os

import duckdb
from oracle import SF, TABLES, compare

from epochlake.plans import ORACLE_SQL, QUERIES


def changed(tmp_path, **own):
    """A folder with the small tables, of which ``own`` are made anew by SQL over the given ones."""
    con = duckdb.connect()
    for t in TABLES:
        if t in own:
            con.execute(f"COPY ({own[t].format(f'{SF}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_subjects_of_more_than_three_digits(spark, tmp_path):
    d = changed(tmp_path, events="SELECT * REPLACE (user_id + 995 AS user_id) FROM '{}'")
    compare(spark, QUERIES["sc1_subjects"], ORACLE_SQL["sc1_subjects"], d)


def test_optical_density_of_nothing(spark, tmp_path):
    d = changed(tmp_path, events="SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value) FROM '{}'")
    compare(spark, QUERIES["sf13_optical_density"], ORACLE_SQL["sf13_optical_density"], d)


def test_haemodynamic_response_is_a_constant(spark):
    plan = QUERIES["sf10_hrf"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
