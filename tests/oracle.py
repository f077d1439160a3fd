"""Comparison of a query with its SQL over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v if isinstance(v, (bool, int)) else str(v)


def compare(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in got), key=repr) == want
