import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from epochlake.llm import alignment as al

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def whole(rows):
    """Rows of whole texts, tokenised at once."""
    tok, bytes_a = al.byte_level(A)
    model, bytes_b, _ = al.pieces(B)
    found, counts = [], Counter()
    for key, text in rows:
        made = None
        if text:
            raw = (" " + text).encode()
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            if b"".join(bytes_a[i] for i in a) == raw == b"".join(bytes_b[i] for i in b):
                made = overlaps(a, b, [len(bytes_a[i]) for i in a], [len(bytes_b[i]) for i in b])
                counts.update(set(made[1]))
        found.append((key, made))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for key, made in found:
        if not made:
            out.append((key, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        groups, links, n_a, n_b = made
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((key, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


def overlaps(a, b, size_a, size_b):
    """Groups and links by comparing byte ranges."""
    place = lambda sizes: [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))]
    ra, rb = place(size_a), place(size_b)
    links = [(x, y) for x, (s, e) in zip(a, ra, strict=True) for y, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
    groups, at = [], 0
    for end in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(([x for x, (s, e) in zip(a, ra, strict=True) if at <= s and e <= end], [y for y, (s, e) in zip(b, rb, strict=True) if at <= s and e <= end]))
        at = end
    return groups, links, len(a), len(b)


TEXTS = [
    None, "", " ", "   ", "a", " a", "a  b", "a   ", "  lead", "tab\tand\nline \n end", "x y z", "don't we'll  'tis", "naïve café ﬁ Ａ é", "日本語 のテキスト。", "🙂🙃 emoji🙂",
    "a<s>b </s> <|endoftext|> <0x0A>", "zero​width \x00 nul", "has▁mark", "▁", "12345 6.78 {}\r\n  return;\r\n", "é combining", "the the the the", "x" * 3000, " sep \x85next \x1cfs", "word " * 50 + "tail  ",
]


@pytest.mark.parametrize("chunk, group", [(3_000_000, 30_000_000), (40, 200)])
def test_documents_equal_whole_texts(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(al, "CHUNK", chunk)
    monkeypatch.setattr(al, "GROUP", group)
    rows = [*enumerate(TEXTS), (None, "the end"), (None, "the end"), (3, "the end"), *((100 + i, "copied text of a hot group") for i in range(200))]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, N_A string").repartition(4)
    got = al.aligned(df, A, B, full=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert sorted(map(tuple, got.collect()), key=repr) == whole(rows)


def test_empty_table_and_other_keys(spark):
    assert al.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    row = al.aligned(spark.createDataFrame([("k", "two words")], "name string, body string"), A, B, "body", "name").first()
    assert (row.name, row.n_a, row.n_groups) == ("k", 2, 2) and row.n_best == row.n_links == row.count_sum


def test_splits_are_proven_on_the_vocabularies(tmp_path):
    assert al.splits(A, B)
    with open(A) as f:
        text = f.read().replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false')
    (tmp_path / "other.json").write_text(text)
    assert not al.splits(str(tmp_path / "other.json"), B)
    texts = ["a b  c\n d", None, "", " x", "\u3000 y z\xa0 z\u200b w"]
    segs, counts = al.segments(pa.array(texts))
    assert segs.to_pylist() == [" a", " b", "  c\n d", "  x", " \u3000 y", " z\xa0 z\u200b", " w"] and counts.tolist() == [3, 0, 0, 1, 3]
    assert al.segments(pa.array(["a b"]), cut=False)[0].to_pylist() == [" a b"]
