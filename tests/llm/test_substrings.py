import hashlib
import re

import numpy as np
import pytest

from epochlake.llm import substrings
from epochlake.llm.fm_index import FMIndex, WaveletTree
from epochlake.llm.substrings import without_repeats


def test_wavelet_tree_counts():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 64, 300):
        x = rng.integers(0, size, 1000)
        tree = WaveletTree(x, size)
        symbol, at = rng.integers(0, size, 500), rng.integers(0, 1001, 500)
        assert (tree.rank(symbol, at) == [(x[:b] == a).sum() for a, b in zip(symbol, at, strict=True)]).all()


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    depth, sigma = int(rng.integers(2, 14)), int(rng.integers(2, 6))
    pieces = [rng.integers(1, sigma + 1, rng.integers(1, 30)) for _ in range(8)]
    text = np.concatenate([np.r_[p, 0] for p in pieces])
    known = {tuple(p[i : i + n].tolist()) for p in pieces for i in range(len(p)) for n in range(1, depth + 1) if i + n <= len(p)}
    streams = [*(rng.integers(1, sigma + 2, rng.integers(0, 25)) for _ in range(6)), *pieces]
    streams = [np.where(np.isin(s, text), s, -1) for s in streams]
    first = np.r_[0, np.cumsum([len(s) for s in streams])]
    index = FMIndex(text, depth)
    length, group = index.matching_statistics(np.concatenate(streams), first)
    padded = np.r_[text, np.zeros(depth, int)]
    _, starts = index.groups(depth)
    for k, s in enumerate(streams):
        for i in range(len(s)):
            want = max(n for n in range(depth + 1) if i + n <= len(s) and (n == 0 or tuple(s[i : i + n].tolist()) in known))
            assert length[first[k] + i] == want
            if want == depth:
                at = index.places[starts[group[first[k] + i]]]
                assert (padded[at : at + depth] == s[i : i + depth]).all()
            else:
                assert group[first[k] + i] == -1


def brute(rows, size):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(2**63 - 1 if k is None else k, word.findall(t or "")) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - size + 1):
            win = tuple(w[i : i + size])
            first[win] = min(first.get(win, k), k)
    out = []
    for (key, _), (k, w) in zip(rows, texts, strict=True):
        gone = {i + j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < k for j in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def documents():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    line, passage, long = prose(8), prose(60), prose(9000)
    rows = [(None, passage), (None, passage + " " + prose(5)), (-3, "x " + passage), (0, None), (1, ""), (2, " \t\n"), (3, prose(12)), (4, prose(13))]
    rows += [(10, long), (11, long[len(long) // 3 :]), (12, long.replace(" ", "\n ")), (12, passage), (12, passage), (13, passage.upper())]
    rows += [(14, " ".join(["ab"] * 200)), (15, " ".join(["ab"] * 14)), (16, " ".join([line] * 30))]
    rows += [(100 + i, prose(40) + " " + line + " " + prose(40)) for i in range(60)]
    rows += [(300 + i, passage) for i in range(80)]
    for i in range(80):
        words = passage.split(" ")
        words[int(rng.integers(60))] = f"own{i}"
        rows.append((500 + i, " ".join(words)))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("size, chunk, shard, share", [(13, 8_000_000, 2_500_000, 0.005), (13, 3_000, 2_000, 0.05), (7, 20_000, 1_000, 2.0)])
def test_repeats_equal_brute_force(spark, monkeypatch, size, chunk, shard, share):
    rows = documents()
    for name, value in (("CHUNK", chunk), ("SHARD", shard), ("SHARE", share)):
        monkeypatch.setattr(substrings, name, value)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, N_WORDS string, chunk int").repartition(5)
    got = without_repeats(df, size=size, full=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, size)


def test_empty_table_and_other_names(spark):
    df = spark.createDataFrame([], "id int, body string")
    assert without_repeats(df, "body", "id").collect() == []
    text = " ".join(map(str, range(20)))
    got = without_repeats(spark.createDataFrame([(2, text), (1, text)], "id int, body string"), "body", "id")
    assert sorted((r.id, r.n_removed) for r in got.collect()) == [(1, 0), (2, 20)]
