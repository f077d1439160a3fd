"""Operators that hold documents against each other or against a list."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochlake.llm import components, cross_polytope, decontaminate, lm, mixing, url_filter, weighted_minhash, words


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- words


def test_words_and_runs():
    random.seed(0)
    texts = ["".join(random.choices(["a", "B", "\n", "\x0b", " ", "é", "É", "x", "\x1c", "日", ","], k=random.randint(0, 12))) for _ in range(1000)] + [None, ""]
    h, first = words.words(pa.array(texts))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [len(x) for x in split] == list(np.diff(first))
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    ids = {}
    for w, x in zip((lower(w) for t in split for w in t), h, strict=True):
        assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)
    _, at = words.runs(h, first, 5)
    assert collections.Counter(at.tolist()) == +collections.Counter({i: max(len(t) - 4, min(1, len(t))) for i, t in enumerate(split)})
    assert [len(b) for _, b in words.blocks(pa.array(["x" * 30, "y", "z" * 5]), 10)] == [1, 2]


# --- components


def test_components(spark):
    random.seed(1)
    pairs = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1400)] + [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for a, b in pairs for x in (a, b) if a != b or x in got}
    assert components.components(spark.createDataFrame(pairs, "a long, b long").limit(0)).count() == 0


# --- near duplicates


def shingled(text):
    """Shingles and their times in plain Python."""
    w = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())
    if not w:
        return collections.Counter([(text or "").strip()] if (text or "").strip() else [])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarities(texts):
    """The higher of two weighted Jaccard similarities of each two texts: by TF-IDF, and by frequency alone."""
    sets = [shingled(t) for t in texts]
    df = collections.Counter(x for s in sets for x in s)
    level = lambda w: math.exp(round(8 * math.log(w)) / 8)
    both = [({x: level((1 + math.log(n)) * math.log(1 + len(texts) / df[x])) for x, n in s.items()}, {x: level(1 + math.log(n)) for x, n in s.items()}) for s in sets]

    def jaccard(a, b):
        least = sum(min(w, b[x]) for x, w in a.items() if x in b)
        return least / (sum(a.values()) + sum(b.values()) - least)

    return {(i, j): max(jaccard(both[i][k], both[j][k]) for k in (0, 1)) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and sets[i].keys() & sets[j].keys()}


def brute_classes(spark, texts):
    label = list(range(len(texts)))
    for (i, j), s in similarities(texts).items():
        if s >= 0.8 - 1e-9:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_against_all_pairs(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [random.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(60):
        b = list(base)
        for _ in range(random.randint(0, 7)):
            b[random.randrange(120)] = random.choice(vocabulary)
        texts.append(" ".join(b))
    texts += [" ".join(random.choices(vocabulary, k=random.randint(1, 150))) for _ in range(120)]
    texts += [texts[70]] * 30 + [None, "", " \n", "!!!", "!!!", "a b", "A, b.", "a c"]
    got = {r.doc_id: (r.class_id, r.kept) for r in weighted_minhash.near_duplicates(frame(spark, texts)).collect()}
    want = brute_classes(spark, texts)
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(want))
    assert all(k == (i == c) for i, (c, k) in got.items())


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "FEW", 1)
    monkeypatch.setattr(weighted_minhash, "BLOCK", 4)
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [random.choice(vocabulary) for _ in range(100)]
    texts = []
    for _ in range(50):
        b = list(base)
        for _ in range(random.randint(2, 9)):
            b[random.randrange(100)] = random.choice(vocabulary)
        texts.append(" ".join(b))
    got = [r.class_id for r in weighted_minhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_classes(spark, texts)


def test_a_group_of_a_third_of_all_rows_keeps_its_links(spark):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = random.sample(vocabulary, 100)
    far = [" ".join(w if i not in cut else f"x{n}y{i}" for i, w in enumerate(base)) for n, cut in enumerate([(k, k + 40) for k in range(10, 50)])]
    texts = [" ".join(base)] + far + [" ".join(random.choices(vocabulary, k=100)) for _ in range(80)]
    got = [r.class_id for r in weighted_minhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0] * 41 + list(range(41, 121))
    two = [" ".join(base), " ".join([*base[:50], "x", *base[51:]])]
    assert [r.class_id for r in weighted_minhash.near_duplicates(frame(spark, two)).collect()] == [0, 0]


def test_near_duplicates_of_nothing(spark):
    assert weighted_minhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in weighted_minhash.near_duplicates(df).collect()), key=repr) == [(1, 1, True), (None, 1, False)]


def test_rows_that_repeat_a_key_are_rows_of_their_own(spark):
    random.seed(13)
    a, b, long = (" ".join(f"{x}{random.randrange(10**6)}" for _ in range(n)) for x, n in (("a", 40), ("b", 40), ("c", 60_000)))
    rows = [(1, a), (1, b), (2, b), (3, a), (None, "n " + a), (None, "m m m m m m m"), (None, "m m m m m m m"), (None, None), (None, ""), (7, long), (8, long + " end"), (9, "x y"), (9, "x y")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, i int").withColumns({"id": F.lit("clash"), "Key": F.lit("clash"), "__row": F.lit(1)})
    got = weighted_minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and len({r.class_no for r in got}) == len({(r.class_no, r.class_id) for r in got}) == 7
    assert collections.Counter((r.doc_id, r.class_id, r.kept) for r in got) == collections.Counter(
        [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, False), (None, None, True), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, False)]
    )
    kept = weighted_minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.i for r in kept.collect()) in ([0, 1, x, 7, 8, 9, y] for x in (5, 6) for y in (11, 12))
    assert weighted_minhash.deduplicated(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 44, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 1 << 44, 100).astype(np.uint64)]))
    wa, wb = (np.stack([np.where(x % 5 == 0, k, 4), np.where(x % 3 == 0, 20, 7)], 1).astype(np.int8) for x, k in ((a, -3), (b, 2)))
    n = 2000
    for k in (0, 1):
        x, y = (weighted_minhash.samples(s, w[:, k], np.array([0, len(s)]), n)[0] for s, w in ((a, wa), (b, wb)))
        assert np.mean(x == y) == pytest.approx(weighted_minhash.similarity(a, wa[:, k : k + 1], b, wb[:, k : k + 1]), abs=0.05)


def test_counters_hold_more_than_32_bits():
    table = np.full(4, 1 << 40)
    assert np.all(weighted_minhash.rarity(1 << 41, table) == np.float32(8 * math.log(math.log(3))))


# --- vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(5, 64))
    rows = [(k, [float(x) for x in centre[k % 5] + rng.normal(size=64) * 0.25 * rng.random()]) for k in range(200)]
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [1.0, None] + [0.0] * 62), (505, [1.0] * 10), (506, [2.0] * 10)]
    rows += [(600 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in cross_polytope.near_vectors(df, block=16).collect()}
    x = {i: np.array(np.array(v, np.float32), np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    near = {i: {j for j in x if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95} for i in x}
    found = sum(got[i].n_links for i in x) / sum(map(len, near.values()))
    assert 0.99 <= found <= 1
    for i, _ in rows:
        reach, new = {i}, {i}
        while new:
            new = set().union(*(near.get(k, set()) for k in new)) - reach
            reach |= new
        assert got[i].component_id == min(reach) and got[i].kept == (i == min(reach))
        assert i in x or got[i].n_links == 0
    assert cross_polytope.near_vectors(df.limit(0)).count() == 0


def test_repeated_and_null_keys_of_vectors(spark):
    v, w = [1.0, 2.0, 0.0], [0.0, 0.0, 5.0]
    rows = [(3, v), (3, v), (1, w), (None, v), (2, [1.0, 2.0, 0.001]), (None, [9.0, -4.0, 1.0]), (4, [-x for x in v])]
    got = collections.Counter(tuple(r) for r in cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == collections.Counter([(3, 3, 2, False), (3, 3, 2, False), (1, 0, 1, True), (None, 3, 2, True), (2, 3, 2, True), (None, 0, None, True), (4, 0, 4, True)])


def test_hadamard_is_orthogonal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


# --- decontamination


def test_leaks_and_paraphrases(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 200
    items = [" ".join(random.choices(vocabulary, k=random.randint(15, 59))) for _ in range(12)]
    clean = [" ".join(random.choices(vocabulary, k=random.randint(1, 400))) for _ in range(60)]
    texts = list(clean)
    for k, item in enumerate(items):
        w = clean[k].split()
        at = random.randrange(len(w) + 1)
        texts.append(" ".join([*w[:at], item.upper() + ",", *w[at:]]))
        changed = item.split()
        for i in random.sample(range(len(changed) - 4), len(changed) // 6):
            changed[i] = random.choice(vocabulary)
        texts.append(" ".join([*w[:at], *changed, *w[at:]]))
    texts += [None, "", " ".join(items[0].split()[:6])]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    got = collections.defaultdict(set)
    for r in decontaminate.contaminated(frame(spark, texts), bench).collect():
        got[r.doc_id].add(r.item_id)
        assert r.share >= 0.6
    assert got == {60 + 2 * k + j: {k} for k in range(12) for j in (0, 1)}
    assert decontaminate.contaminated(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_items_of_few_words_and_rows_without_keys(spark):
    random.seed(14)
    vocabulary = [f"w{i}" for i in range(500)]
    item = " ".join(random.choices(vocabulary, k=30))
    clean = " ".join(random.choices(vocabulary, k=300))
    long = " ".join(random.choices(vocabulary, k=100_000))
    rows = [(None, "x " + item), (7, clean), (7, item), (None, clean), (7, item), (None, None), (1, ""), (2, long), (3, long + " " + item + " " + long)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, i int").withColumns({"item_id": F.lit("clash"), "Share": F.lit("clash")})
    bench = spark.createDataFrame([(1, item), (1, item), (2, clean.split()[3]), (3, " ".join(clean.split()[:7])), (None, " ".join(long.split()[:7]))], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.contaminated(docs, bench).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in got) == {(None, 1): 2, (7, 1): 4, (3, 1): 2}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.i for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert decontaminate.decontaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_the_gate_of_marked_words_loses_nothing(spark):
    random.seed(15)
    vocabulary = [f"w{i}" for i in range(1500)] + ["the", "of", "and", "to"] * 150
    items = [" ".join(random.choices(vocabulary, k=random.randint(8, 70))) for _ in range(60)]
    texts = []
    for item in items:
        for share in (0.0, 0.1, 0.2, 0.3, 0.38):
            w = item.split()
            for i in random.sample(range(len(w)), int(share * len(w))):
                w[i] = random.choice(vocabulary)
            spread = [x for y in w for x in (y, *random.choices(vocabulary, k=random.choice([0, 0, 1])))]
            texts.append(" ".join(random.choices(vocabulary, k=random.randint(0, 90)) + random.choice([w, spread]) + random.choices(vocabulary, k=random.randint(0, 90))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    how = decontaminate.Search(frame(spark, texts), bench, "text", "doc_id", "item_id", "text", None)
    found = how.items(0).value
    h, first = words.words(pa.array(texts), words.LOOSE, True)
    with_gate = decontaminate.search(h, first, how.table.value, found)
    found.enough = np.full(len(items), -1.0)
    assert [x[:2] for x in with_gate] == [x[:2] for x in decontaminate.search(h, first, how.table.value, found)]
    # every text that holds 0.8 of an item's words in order close together is found, by brute force over all pairs
    have = {x[:2] for x in with_gate}
    folded = [[w.lower() for w in t.split()] for t in texts]
    for k, item in enumerate(items):
        w = item.split()
        for t in range(5 * k, 5 * k + 5):
            if decontaminate.common(decontaminate.masks(w), len(w), folded[t]) >= 0.8 * len(w) and len(folded[t]) < 1.5 * len(w):
                assert (t, k) in have
    assert {t // 5 for t, _ in have} == set(range(60)) and sum(t // 5 == k for t, k in have) >= 0.8 * len(texts)


def test_products_are_those_of_the_whole_matrix(monkeypatch):
    rng = np.random.default_rng(16)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, n) % 3000) for n in rng.integers(0, 300, 50)]
    q = rng.standard_normal((decontaminate.SLOTS, 5), np.float32)
    for most, step in ((1, 7), (5_000, 1_024), (10**9, 64)):
        monkeypatch.setattr(decontaminate, "WORDS", most)
        monkeypatch.setattr(decontaminate, "STEP", step)
        made, whole = decontaminate.Product(q), []
        for at in range(0, len(texts), 9):
            h, first = words.words(pa.array(texts[at : at + 9]), words.LOOSE, True)
            made.add(h, first)
            for a, b in itertools.pairwise(first.tolist()):
                whole += [np.bincount((h[k : min(k + decontaminate.HALF, b)] % np.uint64(decontaminate.SLOTS)).astype(int), minlength=decontaminate.SLOTS) for k in range(a, b, decontaminate.HALF)]
        made.add(np.zeros(0, np.uint64), np.zeros(3, np.int64))
        matrix = np.array(whole, np.float32)
        assert np.allclose(made.total(), matrix.T @ (matrix @ q), rtol=1e-3, atol=1e-2)
    assert not decontaminate.Product(q).total().any()


def test_singular_vectors_are_fitted_on_every_document(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FIT", 1, raising=False)
    rng = np.random.default_rng(17)
    texts = [" ".join(f"topic{k % 40}word{x}" for x in rng.integers(0, 30, 16)) for k in range(400)]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame([(0, texts[0]), (1, "not in any document but an item"), (None, None)], "item_id long, text string")
    vectors = decontaminate.Search(docs, bench, "text", "doc_id", "item_id", "text", None).vectors
    weight = decontaminate.rarity(docs, "text")[1]
    matrix = np.zeros((len(texts) + 2, decontaminate.SLOTS), np.float32)
    for row, t in zip(matrix, [*texts, texts[0], "not in any document but an item"], strict=True):
        h, _ = words.words(pa.array([t]), words.LOOSE, True)
        np.add.at(row, (h % np.uint64(decontaminate.SLOTS)).astype(int), weight[(h % np.uint64(decontaminate.SLOTS)).astype(int)])
    # forty topics of other words each: whitened, the leading vectors turn the whole matrix's leading directions to length 1
    u, _, _ = np.linalg.svd(matrix, full_matrices=False)
    turned = u[:, :40].T @ (matrix @ (vectors / weight[:, None]))
    lengths = np.linalg.svd(turned, compute_uv=False)
    assert len(lengths) == 40 and np.all((lengths > 0.9) & (lengths < 1.1)), lengths


def test_benchmark_in_slices(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "one two three four five six seven eight nine ten eleven twelve"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole = decontaminate.contaminated(frame(spark, texts), bench).select("doc_id", "item_id").collect()
    monkeypatch.setattr(decontaminate, "SLICE", 20)
    assert sorted(decontaminate.contaminated(frame(spark, texts), bench).select("doc_id", "item_id").collect()) == sorted(whole) == [(0, 0), (1, 1)]
    assert decontaminate.decontaminated(frame(spark, [*texts, "none of them"]), bench).collect()[0].doc_id == 2


def test_common_subsequence():
    random.seed(7)
    for _ in range(100):
        a, b = (random.choices(range(5), k=random.randint(1, 30)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common(decontaminate.masks(a), len(a), b) == table[-1][-1]


# --- language model


def tokenised(texts):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "</s> "] for t in texts]


def quantised(n):
    """The count that the level of ``n`` stands for: the geometric middle of the whole numbers of that level."""
    level = lambda k: 1 + math.floor(math.log(k) / math.log(1.5) + 1e-9)
    same = [k for k in range(1, 4 * n + 4) if level(k) == level(n)]
    return math.sqrt(same[0] * same[-1])


@pytest.mark.parametrize("joined", [False, True])
def test_scores_against_plain_counts(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lm, "CHUNK", 1500)
    random.seed(8)
    texts = [" ".join(random.choices(["The", "the", "cat", "Dog", "É", "é", "x\x1cy", "zz\n", *[f"w{i}" for i in range(60)]], k=random.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "unseen words", texts[3], texts[3], "the cat " * 5000]
    clash = ("k", "b", "row", "__row", "r", "t", "c", "k0", "part")
    df = frame(spark, texts).withColumns({"score": F.lit("clash"), **{c: F.lit(c) for c in clash}})
    known = lm.learned(F.col("doc_id"))
    model = lm.Model(df.where(known))
    got = {r.doc_id: r for r in lm.score(df, model, keep=("doc_id", "score", *clash)).collect()}
    assert all(r[c] == c for r in got.values() for c in clash)
    split = tokenised(texts)
    train = [t for i, t in enumerate(split) if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    seen = collections.Counter(x for t in train for x in zip(["</s> ", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    seen = {x: quantised(k) for x, k in seen.items()}
    after = collections.Counter()
    for (w, _), k in seen.items():
        after[w] += k
    assert model.prior in lm.PRIORS
    off = []
    for i, t in enumerate(split):
        p = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(sum(map(math.log10, p)))
        want = sum(math.log10((seen.get((b, w), 0) + model.prior * q) / (after[b] + model.prior)) for b, w, q in zip(["</s> ", *t], t, p, strict=False))
        off.append(abs(got[i].score - want))
        assert got[i].score == pytest.approx(want, rel=0.1, abs=1.0)
    # the filter takes a pair in 1,000 for seen here, and lifts one in 300 by a level
    assert sum(off) <= 0.005 * sum(map(len, split)) and np.median(off) < 0.02


def test_probabilities_after_any_word_add_up_to_one(spark):
    random.seed(16)
    weight = [1 / (k + 1) for k in range(3000)]
    vocabulary = [f"w{i}" for i in range(3000)]
    df = frame(spark, [" ".join(random.choices(vocabulary, weight, k=80)) for _ in range(600)])
    model = lm.Model(df)
    look = lm.look_of(model.sent.value)
    all_words = look.keys
    p = (look.counts(all_words) + lm.ADD) / model.under
    assert p.sum() + lm.ADD / model.under == pytest.approx(1)
    excess = []
    for at in range(0, len(all_words), 37):
        before = np.full(len(all_words), all_words[at])
        seen, follow = lm.level_count(look.level(lm.pair(before, all_words))), look.following(before)
        for prior in (lm.LEAST, model.prior):
            total = ((seen + prior * p) / (follow + prior)).sum() + prior * lm.ADD / model.under / (follow[0] + prior)
            assert 1 - 1e-9 <= total <= 1 + 3 / (follow[0] + prior)  # three pairs by error at most
            excess.append(total - 1)
    assert np.mean(excess) <= lm.ERROR


def test_the_prior_is_the_likeliest(spark):
    random.seed(17)
    loose = lm.Model(frame(spark, [" ".join(random.choices([f"w{i}" for i in range(200)], k=40)) for _ in range(400)]))
    follow = {f"w{i}": [f"w{(i * 7 + k) % 200}" for k in range(3)] for i in range(200)}

    def chain():
        out = ["w0"]
        for _ in range(40):
            out.append(random.choice(follow[out[-1]]))
        return " ".join(out)

    tight = lm.Model(frame(spark, [chain() for _ in range(400)]))
    assert tight.prior < loose.prior


@pytest.mark.parametrize("lead", [0, 3])
def test_both_ways_give_the_same_scores(spark, monkeypatch, lead):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 60))) for _ in range(150)] + [None, "", "unseen words", "w1 w2 " * 500]
    df = frame(spark, texts)
    scores = lambda: {r.doc_id: r for r in lm.score(df, lm.Model(df.where("doc_id % 10 != 0"))).collect()}
    want = scores()
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lm, "CHUNK", 1500 if lead else 4 << 20)
    got = scores()
    assert got == want and len(got) == len(texts)


def test_no_training_text(spark, monkeypatch):
    df = frame(spark, ["a b", None])
    for most in (lm.BROADCAST_BYTES, -1):
        monkeypatch.setattr(lm, "BROADCAST_BYTES", most)
        got = lm.score(df, lm.Model(df.limit(0))).collect()
        assert {(r.train_tokens, r.n_known, r.score) for r in got} == {(0, 0, 0.0)}
        assert lm.score(df.limit(0), lm.Model(df)).count() == 0


def test_log_filter_has_no_misses_and_few_errors():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    q = lm.levels(counts)
    first, others, data = lm.segment(keys, q, 16)
    f = lm.LogFilter(0, np.array([first, others]), np.frombuffer(data, np.uint8), 16)
    assert np.all(f.level(keys) >= q) and np.mean(f.level(keys) != q) < 0.05
    assert np.mean(f.level(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)) > 0) < 2e-4
    assert np.all(np.abs(np.log(lm.level_count(lm.levels(counts)) / counts)) <= math.log(lm.BASE))
    assert np.all(words.unmix(words.mix(keys)) == keys)


# --- mixing


def test_targets_are_filled_to_their_caps(spark):
    rows = [("a", 10), ("b", 500), ("c", 30), (None, 60), ("d", 0)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    size, total = dict(rows), 1.5 * sum(s for _, s in rows)
    target = dict.fromkeys(size, 0.0)
    free = set(size)
    while True:
        left = total - sum(2 * size[s] for s in size if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 2.0 * size[s] for s in size}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    assert {s: r.target for s, r in got.items()} == pytest.approx(target)


def test_mix_and_sequence(spark):
    random.seed(10)
    rows = [(i, " ".join(["w"] * random.randint(0, 40)), random.choice(["a", "b", "c", None])) for i in range(300)] + [(0, "x y", "a"), (0, "x y", "a"), (999, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rank": F.lit(1), "Size": F.lit("clash"), "goal": F.lit(2)})
    mixed = mixing.mix(df).cache()
    out = mixed.collect()
    assert len(out) == len(rows) and sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) for r in out)
    sources = ("a", "b", "c", None)  # by rank
    for s in sources:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 21 and sum(r.size for r in own) == own[0].source_size
        assert all(r.size == 0 and r.taken == 0 or r.taken in (0, r.size, 2 * r.size) for r in own)
        assert all(len(r.positions) * r.size == r.taken and (r.positions[0] if r.positions else None) == r.position for r in own)
    stream = mixing.sequence(mixed).collect()
    text = {(r.doc_id, r.source, r.text) for r in out}
    assert all((r.doc_id, r.source, r.text) in text for r in stream)
    assert collections.Counter(r.source for r in stream) == +collections.Counter({s: sum(len(r.positions) for r in out if r.source == s) for s in sources})
    assert [r.position for r in stream] == sorted(r.position for r in stream)
    assert mixing.mix(df.limit(0)).count() == 0
    # positions by brute force: schedules summed up over fine steps, against the total of all sources
    x = np.linspace(0, 1, 200_001)
    goal = {s: int(next(r.target for r in out if r.source == s)) for s in sources}
    due = {}
    for rank, s in enumerate(sources):
        first, last = mixing.SCHEDULES[rank % 3]
        rate = first + (last - first) * x
        due[s] = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        due[s] *= goal[s] / due[s][-1]
    whole = sum(due.values())
    for s in sources:
        own, size = [r for r in out if r.source == s], next(r.source_size for r in out if r.source == s)
        begins = sorted(hashlib.md5(f"{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest() + f"{r.size:09d}" + f"|{i}" for i, r in enumerate(own))
        at, want, got = 0, [], sorted(p for r in own for p in r.positions)
        for turn in range(2):
            for b in begins:
                r = own[int(b.split("|")[1])]
                if r.size and goal[s] - at >= r.size / 2:
                    want.append(np.interp(np.interp(at, due[s], x), x, whole) / whole[-1])
                at += r.size
        assert len(want) == len(got) and np.allclose(sorted(want), got, atol=1e-5)
        # the last copy begins within one document of the end of the source's budget
        assert np.interp(np.interp(want[-1] * whole[-1], whole, x), x, due[s]) >= goal[s] - 1.5 * max(r.size for r in own) - 0.1


def test_mix_of_long_texts_ties_and_null_keys(spark):
    rows = [(None, "x " * 300_000, "a"), (None, "y z", "a"), (None, "y z", "a"), (5, "p q r", "a"), (5, "s t", "a"), (6, "", "b"), (7, None, "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.size for r in out) == [0, 0, 2, 2, 2, 3, 300_000] and all(r.taken <= 2 * r.size for r in out)
    assert {(r.source_size, r.target, r.taken) for r in out if r.source == "b"} == {(0, 0.0, 0)}
    assert sum(r.taken for r in out) == pytest.approx(450_014, abs=150_001)


def test_due_time_inverts_the_schedule(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for rank, (a, b) in enumerate(mixing.SCHEDULES):
        for r in df.select("u", mixing.due_time(F.col("u"), F.lit(rank)).alias("x")).collect():
            assert (a * r.x + (b - a) * r.x**2 / 2) / ((a + b) / 2) == pytest.approx(r.u, abs=1e-12)


# --- URL lists


def test_lists_in_force(spark):
    entries = [
        ("ads", "example.com", True, "2024-01-10"),
        ("ads", "example.com", False, "2024-02-10"),
        ("ads", "example.com", True, "2024-03-10"),
        ("bad", "m.example.com", True, "2024-01-01"),
        ("dir", "other.org/x/", True, "2024-01-01"),
        ("tie", "tie.org", True, "2024-01-05"),
        ("tie", "tie.org", False, "2024-01-05"),
        (None, "example.com", True, "2024-01-01"),
    ]
    asked = [
        ("http://example.com/a", "2024-01-09", ""),
        ("http://example.com/a", "2024-01-10", "ads"),
        ("HTTPS://u@M.Example.com.:80/a?b", "2024-02-09", "ads,bad"),
        ("http://m.example.com", "2024-02-10", "bad"),
        ("http://notexample.com/", "2024-04-01", ""),
        ("http://example.com", "2024-12-31", "ads"),
        ("http://other.org/x/y", "2024-05-01", "dir"),
        ("http://other.org/xx/y", "2024-05-01", ""),
        ("http://tie.org", "2024-05-01", ""),
        ("no url", "2024-05-01", ""),
        (None, "2024-05-01", ""),
        ("http://example.com", None, ""),
    ]
    asked += asked[:2]
    e = spark.createDataFrame(entries, "list_name string, pattern string, listed boolean, day string").withColumn("day", F.to_date("day"))
    c = spark.createDataFrame(asked, "url string, fetched string, want string").withColumns({"fetched": F.to_timestamp("fetched"), "pattern": F.lit("clash"), "Lists": F.lit("clash")})
    got = url_filter.filter_urls(c, e).collect()
    assert len(got) == len(asked)
    assert all(",".join(r.lists) == r.want and r.blocked == bool(r.want) for r in got)
    assert url_filter.filter_urls(c.limit(0), e).count() == 0
    assert url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0
