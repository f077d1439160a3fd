import numpy as np
import pytest

from epochlake.llm import weighted_minhash as wm


def test_similarities_to_many_are_those_to_each(monkeypatch):
    monkeypatch.setattr(wm, "GATHER", 50)
    rng = np.random.default_rng(3)
    made = lambda: np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
    sets = [(k, rng.integers(-4, 20, (len(k), 2)).astype(np.int8)) for k in (made() for _ in range(12))]
    sizes = [len(k) for k, _ in sets]
    k, w = np.concatenate([k for k, _ in sets]), wm.weight(np.concatenate([w for _, w in sets]))
    text = np.repeat(np.arange(12), sizes)
    order = np.argsort(k, kind="stable")
    keys, first = np.unique(k[order], return_index=True)
    got = wm.similarities(*sets[0], keys, np.append(first, len(k)), text[order], w[order], np.add.reduceat(w, np.cumsum([0, *sizes[:-1]])))
    assert got.tolist() == pytest.approx([wm.similarity(*sets[0], *x) for x in sets])


def test_a_large_component_is_copied_by_what_differs_alone(spark, monkeypatch):
    monkeypatch.setattr(wm, "BLOCK", 8)
    rows = [(7, i, 0 if i < 60 else i) for i in range(64)]
    large = spark.createDataFrame(rows, "band bigint, id bigint, c bigint")
    sizes = large.selectExpr("id", "100L AS size")
    made = wm.dealt(large, sizes).collect()
    assert len(made) <= 60 + 4 * 9
    groups = {}
    for r in made:
        groups.setdefault((r.lo, r.hi), []).append(r)
    met = {frozenset((x.id, y.id)) for g in groups.values() for x in g for y in g if x.own == x.lo and y.own == y.hi and x.id != y.id}
    assert met >= {frozenset((a, b)) for _, a, c in rows for _, b, d in rows if c != d}
    assert max(map(len, groups.values())) <= 2 * 24


def test_language_model_keeps_no_pairs_beside_its_filter(spark, tmp_path):
    import glob

    from epochlake.llm.lm import Model
    from epochlake.llm.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/lm-*"))
    Model(spark.createDataFrame([("a b c a b",), ("b c",)], "text string"))
    (made,) = set(glob.glob(f"{root}/lm-*")) - before
    assert sorted(p.rpartition("/")[2] for p in glob.glob(f"{made}/*")) == ["filter", "totals", "words"]


@pytest.mark.parametrize("joined", [False, True])
def test_the_prior_is_fitted_on_all_training_texts(spark, monkeypatch, joined):
    """By itself and in the pass of scoring alike; before, on those that a hash took, here one or two."""
    import random

    from pyspark.sql import functions as F

    from epochlake.llm import lm

    if joined:
        monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lm, "CHUNK", 1500)
    monkeypatch.setattr(lm, "FIT", 1, raising=False)
    random.seed(5)
    loose = [" ".join(random.choices([f"w{i}" for i in range(200)], k=40)) for _ in range(60)]
    tight = [" ".join(f"w{(k * 7 + i) % 200}" for i in range(40)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate([*loose, *tight, None, ""])), "doc_id long, text string")
    known = F.coalesce(F.col("doc_id") % 10 != 0, F.lit(True))
    model = lm.Model(df.where(known))
    names = [f"p{i}" for i in range(len(lm.PRIORS))]
    likely = lm.evaluate(df.where(known).select(F.col("text").alias("t")), model, lm.trials(model.under), names).agg(*[F.sum(c) for c in names]).first()
    assert model.prior == lm.PRIORS[int(np.argmax(likely))]
    want = {r.doc_id: r for r in lm.score(df, model).collect()}
    model = lm.Model(df.where(known))
    assert {r.doc_id: r for r in lm.score(df, model, trained=known).collect()} == want and len(want) == 122


def test_texts_are_not_shuffled_for_what_they_ask(spark, monkeypatch):
    from epochlake.llm import lm
    from epochlake.llm.shared import Scratch

    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(1, "a b c"), (2, "b c")], "doc_id long, text string")
    plans = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, made, name, *how: plans.append((name, made._jdf.queryExecution().optimizedPlan().toString())) or keep(self, made, name, *how))
    lm.score(df, lm.Model(df), prior=lm.LEAST).collect()
    asking = [p for name, p in plans if name.startswith("a")]
    assert asking and not any("FlatMapGroupsInArrow" in p for p in asking)
