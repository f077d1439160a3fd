import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

from epochlake.llm.queries import ORACLE_SQL, QUERIES

NAMES = {f"op{n}_" for n in range(1, 13)}


def test_each_operator_has_a_query():
    assert {q[: q.index("_") + 1] for q in QUERIES} == NAMES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_all_queries_over_the_whole_table(spark):
    """Queries without SQL: a row for each of the table's, or what their contracts fix."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    run = {q.split("_")[0]: QUERIES[q](spark, SF).collect() for q in QUERIES if q not in ORACLE_SQL}
    for op in ("op2", "op5", "op6", "op10"):
        assert sorted(r.doc_id for r in run[op]) == sorted(docs)
    assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in run["op2"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in run["op5"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in run["op6"])
    assert len({r.train_tokens for r in run["op6"]}) == 1 and sum(r.score for r in run["op6"]) > sum(r.base_score for r in run["op6"])
    assert all(r.kept == (r.class_id == r.doc_id) for r in run["op10"])
    assert {k for r in run["op9"] for k in r.doc_ids} == set(docs)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    folded = {k: " ".join(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower())) for k, t in docs.items()}
    whole = {(d, i) for i, t in items.items() for d, f in folded.items() if " ".join(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t.lower())) in f}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in run["op1"]}


def test_near_vectors_equal_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = (x @ x.T >= 0.95).sum(1) - 1
    assert {r.vec_id: r.n_links for r in QUERIES["op8_near_vectors"](spark, SF).collect()} == {r.vec_id: int(k) for r, k in zip(rows, n, strict=True)}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from epochlake.llm.shared import Scratch

    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("position", F.lit("clash"))
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = scratch.keep(stage(spark, docs, SF), name)
        if name == "pack_tokens":
            break
        if name == "mix_sources":
            order = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name != "mix_sources":
            assert 0.6 * before < docs.count() <= before
            assert all(seen[r.doc_id] == r.text for r in docs.collect())
    assert docs.where("n_tokens > 2048").count() == 0
    rows = docs.orderBy("shard", "win", "row").collect()
    at = 0
    for _, window in itertools.groupby(rows, lambda r: (r.shard, r.win)):
        own = [k for r in window for k, piece in zip(r.doc_ids, r.pieces, strict=True) if piece == 0]
        assert sorted(own) == sorted(order[at : at + len(own)])  # windows hold neighbours of the order of training
        at += len(own)
    assert at == len(order)


def test_stages_go_by_rows_and_not_by_keys(spark, tmp_path):
    import corpus_pipeline

    src = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400 and lang = 'en'").limit(40).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a, b, c = (src[i].text for i in (0, 1, 2))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (None, c, "en", None, 1), (None, c, "en", "s", 1), (None, c + " " + item, "en", "s", 1), (7, item, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0)]
    rows += [(100 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(src[3:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).withColumns({"id": F.lit("clash"), "Size": F.lit("clash")})
    stage = dict(corpus_pipeline.STAGES)

    def through(name, docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/in-{name}")
        return stage[name](spark, spark.read.parquet(f"{tmp_path}/in-{name}"), SF)

    texts = lambda d: collections.Counter(r.text for r in d.collect() if r.text in (a, b, c, item, c + " " + item, None, ""))
    assert texts(through("language_id", df)) == {a: 1, b: 1, c: 2, c + " " + item: 1, item: 1}
    found = texts(through("near_dedup", df))
    assert found[a] == found[b] == found[item] == found[None] == found[""] == 1 and found[c] + found[c + " " + item] in (1, 2)
    assert texts(through("decontaminate", df)) == {a: 1, b: 1, c: 2, None: 1, "": 1}
    mixed = through("mix_sources", df)
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS and {r.text for r in mixed.collect()} <= {r[1] for r in rows} - {None, ""}
    packed = through("pack_tokens", df).collect()
    assert sum(piece == 0 for r in packed for piece in r.pieces) == len(rows)
    for name, f in stage.items():
        assert through(name, df.limit(0)).count() == 0, name
