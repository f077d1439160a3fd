"""Operators that look at each row by itself: tokens, languages, packing, archives."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epochlake.llm import language, packing, token_count, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "é日本😀", "<|endoftext|> x", "x" * 5000, " " * 5000, "ab cd\n" * 3000, "don't 12 ,,"]


def docs(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_spliced_counts_equal_whole_ones():
    tok = token_count.tokenizer(JSON)
    random.seed(1)
    parts = ["a", "the ", "  ", "\n", "é", "<|endoftext|>", "<|endof", "text|>", "'ll", "123", "!!", "日本", "😀", " x", "\t", "\r\n", "word"]
    for _ in range(200):
        some = parts[: random.randint(1, len(parts))]
        text = "".join(random.choice(some) * random.choice([1, 1, 1, 5, 40]) for _ in range(random.randint(0, 300)))
        assert token_count.count_long(text, tok, random.choice([60, 64, 100, 300]), random.choice([1, 8, 30])) == len(tok.encode(text, add_special_tokens=False))


def test_counts_of_texts_beyond_a_chunk_equal_the_library(spark):
    tok = token_count.tokenizer(JSON)
    random.seed(5)
    texts = ["".join(random.choices(["word ", "don't ", "\n\n", "  ", "日本", "123 ", "<|endoftext|>"], k=n)) for n in (9_000, 30_000, 200_000)] + ["z" * 100_000, " " * 80_000]
    got = token_count.count_tokens(docs(spark, texts * 2), JSON).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(tok.encode(t, add_special_tokens=False)) for t in texts] * 2


def test_token_counts_of_odd_rows(spark):
    tok = token_count.tokenizer(JSON)
    got = token_count.count_tokens(docs(spark, ODD, N_TOKENS="clash"), JSON).collect()
    assert len(got) == len(ODD) and got[0].__fields__ == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for r in got:
        want = len(tok.encode(r.text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 1024)
    assert token_count.count_tokens(docs(spark, ["a"]).limit(0), JSON).count() == 0


def test_best_fit_decreasing_against_a_scan():
    random.seed(2)
    for _ in range(200):
        size = random.choice([1, 2, 3, 7, 8, 33, 100])
        lengths = [random.randint(0, size) for _ in range(random.randint(0, 60))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms[rooms.index(min(fit))] -= n
            else:
                rooms.append(size - n)
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_round_trip(spark):
    texts = [*ODD, *(f"word{i} " * (i * 7) for i in range(40))]
    packed = packing.pack(docs(spark, texts), RANKS, length=64, window=500).cache()
    back = {r.key: r.text for r in packing.unpack(packed, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    for r in packed.collect():
        ends = r.cu_seqlens
        assert ends[0] == 0 and ends[-1] == r.n_tokens <= 64 and len(r.ids) == len(r.position_ids) == 128
        at = memoryview(r.position_ids).cast("H")
        for a, b in zip(ends, ends[1:], strict=False):
            assert list(at[a:b]) == list(range(b - a))
    assert packing.pack(docs(spark, ["a"]).limit(0), RANKS).count() == 0


def test_packing_follows_the_order_and_fills_rows(spark):
    random.seed(12)
    rows = [(i // 2 if i % 7 else None, f"w{i} " * random.randint(1, 60), i) for i in range(400)]
    df = spark.createDataFrame(random.sample(rows, 400), "doc_id long, text string, place long").withColumns({"key": F.lit("clash"), "shard": F.lit("clash"), "n": F.lit(1)}).repartition(13)
    packed = packing.pack(df.select("doc_id", "key", "shard", "n", F.concat(F.lit("#"), F.col("place").cast("string"), F.lit(" "), "text").alias("text"), "place"), RANKS, length=128, window=3000, order=("place",))
    rows = packed.orderBy("shard", "win", "row").collect()
    enc, last, windows = packing.encoding(RANKS), -1, {}
    for r in rows:
        ids = list(memoryview(r.ids).cast("H"))
        for a, b, piece in zip(r.cu_seqlens, r.cu_seqlens[1:], r.pieces, strict=False):
            if piece == 0:
                windows.setdefault((r.shard, r.win), []).append(int(enc.decode(ids[a:b])[1:].split()[0]))
    for w in sorted(windows):
        assert sorted(windows[w]) == list(range(last + 1, last + 1 + len(windows[w])))
        last = max(windows[w])
    assert last == 399
    assert sum(r.n_tokens for r in rows) >= 0.9 * 128 * len(rows)


def test_languages_held_out(spark):
    words = {"aa": "ska blim torv unde gral", "bb": "cheno ritu pala zomi neu"}
    random.seed(3)
    rows = [(i, " ".join(random.choices(words[x].split(), k=30)), x) for i in range(80) for x in (random.choice(list(words)),)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(df, F.col("doc_id") < 40)
    got = language.identify(df, learned).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 and not r.rejected for r in got)
    odd = language.identify(docs(spark, [None, "", "12 !!", "\n"], score="clash"), learned).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in odd} == {("und", 0.0, True)}
    assert language.learn(df.limit(0)) == {}
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}


def test_a_label_with_one_short_document_takes_nothing_from_others():
    random.seed(6)
    make = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(3, 8)))
    shared = [make() for _ in range(100)]
    words = {lang: shared + [make() for _ in range(300)] for lang in ("aa", "bb", "cc")}
    text = lambda lang, n: " ".join(random.choices(words[lang], k=n))
    sampled = [(lang, text(lang, 400)) for lang in words for _ in range(10)]
    asked = [(lang, text(lang, 80)) for lang in words for _ in range(30)]
    for rare in ("zz zz zz zzz", "ok"):
        learned = language.dictionaries([*sampled, ("rare", rare)])
        assert learned["rare"] == rare.encode() and all(len(learned[lang]) > 15_000 for lang in words)
        found = [language.classify(t, language.compressors(tuple(learned.items()))) for _, t in asked]
        assert [(x[0], x[2]) for x in found] == [(lang, False) for lang, _ in asked]
    # a label with a tenth of the others' text is still told
    learned = language.dictionaries([x for x in sampled if x[0] != "cc"] + [x for x in sampled if x[0] == "cc"][:1])
    found = [language.classify(t, language.compressors(tuple(learned.items()))) for _, t in asked]
    assert [(x[0], x[2]) for x in found] == [(lang, False) for lang, _ in asked]


def test_sample_is_bounded_and_skips_what_is_not_learned(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 3 = 0, null, 'aa') as lang")
    got = language.sample(df, F.col("doc_id") % 2 == 0, per_language=16).collect()
    assert 0 < len(got) <= 16 and all(int(r.text[1:]) % 2 == 0 and int(r.text[1:]) % 3 for r in got)
    same = spark.range(5000).selectExpr("7L as doc_id", "concat('t', id) as text", "'aa' as lang")
    assert [r.text for r in language.sample(same).collect()] == ["t0"]
    monkeypatch.setattr(language, "LANGUAGES", 2)
    many = spark.range(600).selectExpr("id as doc_id", "'some text' as text", "if(id < 300, 'zz', if(id < 500, 'aa', concat('x', id))) as lang")
    assert set(language.learn(many)) == {"aa", "zz"}


def test_ties_repeats_and_long_texts_of_languages(spark):
    learned = {"bb": b"same words in both", "aa": b"same words in both"}
    assert language.classify("same words", language.compressors(tuple(sorted(learned.items()))))[::2] == ("aa", True)
    random.seed(9)
    content = {x: " ".join(random.choices([f"{x}{a}{b}" for a in "aeiou" for b in ("st", "rn", "ll", "k")], k=3000)) for x in "pqr"}
    df = docs(spark, [content["q"] * 20, content["q"] * 20, content["p"][:500], "12 " * 100_000], lang_pred="clash")
    got = language.identify(df, {x: t.encode() for x, t in content.items()}).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["q", "q", "p", "und"] and got[0].score == got[1].score


def test_archives_round_trip(spark, tmp_path):
    random.seed(4)
    rows = []
    for i in range(40):
        n = random.choice([0, 1, 50, 99, 100, 101, 8191, 8192, 8193, 40_000])
        rows.append((i, f"http://x/{i}", bytearray(random.choice([13, 10, 255, 0, 65, 40]) for _ in range(n))))
    rows += [(100 + k, None, rows[5][2]) for k in range(5)] + [(7, "http://x/again", rows[7][2]), (200, "u", None), (None, "v", bytearray(b"null key"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary")
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, "page_id", "url", "html", segment=3000, chunk=1000)
    found = warc.read_records(spark, path).cache()
    assert found.where("kind = 'continuation'").count() > 0
    got = [(r.key, r.payload_bytes, r.payload_digest) for r in warc.captures(found).collect()]
    want = [(k, len(b or b""), hashlib.sha256(bytes(b or b"")).hexdigest()) for k, _, b in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_broken_segments_are_told(spark):
    block = warc.HTTP + warc.chunked(b"x" * 5000)
    parts = [block[i : i + 1000] for i in range(0, len(block), 1000)]
    n = len(parts)

    def rows(key, keep, total):
        return [("response" if i == 0 else "continuation", key, None, None if i == 0 else key, i + 1, total if i == n - 1 else None, None, None, None, bytearray(parts[i]), "whole") for i in keep]

    found = spark.createDataFrame(rows("ok", [*range(n), 2], len(block)) + rows("gap", [i for i in range(n) if i != 2], len(block)) + rows("cut", range(n - 1), None) + rows("long", range(n), len(block) + 1), warc.RECORD)
    assert {r.id: r.status for r in warc.reassemble(found).collect()} == {"ok": "whole", "gap": "missing", "cut": "missing", "long": "length"}
    made = {r.id: r for r in warc.payloads(warc.reassemble(found)).collect()}
    assert bytes(made["ok"].payload) == b"x" * 5000 and all(r.payload is None for k, r in made.items() if k != "ok")
    got = warc.captures(found).collect()
    assert sorted((r.status, r.payload_bytes) for r in got) == [("length", None), ("missing", None), ("missing", None), ("whole", 5000)]


def test_malformed_archives_have_rows(spark, tmp_path):
    import gzip

    def rec(kind, key, block, length=None, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": warc.record_id(key), "X-Capture-Key": key, **more, "Content-Length": len(block) if length is None else length}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v != "").encode() + b"\r\n" + block + b"\r\n\r\n"

    good = warc.HTTP + warc.chunked(b"y" * 150)
    first = [
        rec("response", 1, good),
        b"no record at all\r\n\r\nnor this\r\n\r\n",
        rec("response", 2, warc.HTTP + b"zz\r\nabc\r\n0\r\n\r\n"),
        rec("response", 3, b"", ""),
        rec("response", 4, good, "many"),
        rec("response", "five", good),
        rec("revisit", 6, b"", **{"WARC-Refers-To": warc.record_id(1)}),
        rec("revisit", 7, b"", **{"WARC-Refers-To": warc.record_id(99)}),
        rec("revisit", 8, b"", **{"WARC-Refers-To": warc.record_id(2)}),
        rec("response", 9, good, 10_000)[:-4],
    ]
    (tmp_path / "w").mkdir()
    for name, data in (("a.gz", b"".join(first)), ("b.gz", rec("response", 10, good)), ("c.gz", b"")):
        (tmp_path / "w" / name).write_bytes(gzip.compress(data))
    got = {(r.key, r.record_type, r.status, r.payload_bytes, r.refers_to) for r in warc.captures(warc.read_records(spark, f"file://{tmp_path}/w")).collect()}
    assert got >= {
        (1, "response", "whole", 150, None),
        (None, None, "malformed", None, None),
        (2, "response", "framing", None, None),
        (3, "response", "malformed", None, None),
        (4, "response", "malformed", None, None),
        (None, "response", "malformed", None, None),
        (6, "revisit", "whole", 150, 1),
        (7, "revisit", "unresolved", None, None),
        (8, "revisit", "framing", None, 2),
        (9, "response", "truncated", None, None),
        (10, "response", "whole", 150, None),
    }


def test_archives_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "row": F.lit("clash"), "digest": F.lit(0)})
    for n, some in ((3, df), (0, df.limit(0))):
        path = f"file://{tmp_path}/w{n}"
        warc.write_warc(some, path, "page_id", "url", "html")
        got = warc.captures(warc.read_records(spark, path)).collect()
        assert sorted((r.key, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)][:n]


def test_chunk_framing():
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"", b"x\r\n", b"-1\r\nabc", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(broken)
