"""Tokens of two tokenizers aligned by the bytes that they cover.

Texts are split before a space behind other than white space, where no token of either vocabulary can reach across: the
byte-level vocabulary's pattern ends a pre-token there, and no piece of the other has a space mark behind another character,
which :func:`splits` verifies on the vocabularies as given (texts stay whole where it fails). So a segment has the same tokens
wherever it stands. Documents become codes of the different segments of a group of chunks; each different segment of the
corpus is tokenised once; a join brings its tokens back to groups, where segments are aligned and documents composed of them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import Scratch, release
from .words import blocks, raw

#: Bytes of texts that are composed at once, and that share a table of segments; a single longer text is a chunk of its own.
CHUNK, GROUP = 3_000_000, 30_000_000
#: Bytes of rows that are sent to a worker at once: a row holds a group's table.
BATCH = "4m"
#: How tables between are stored.
STORED = {"spark.sql.parquet.compression.codec": "zstd"}
MARK = "▁"


@functools.lru_cache(maxsize=2)
def byte_level(path: str):
    """(tokenizer, bytes of each id) of a byte-level vocabulary; special strings in texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the format's letters for bytes: these are themselves
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    table = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(letters[c] for c in token)
    return tok, table


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """(processor, bytes of each id, id of a lone space mark) of a vocabulary of pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    return model, table, model.piece_to_id(MARK)


@functools.lru_cache(maxsize=2)
def splits(path_a: str, path_b: str) -> bool:
    """Whether neither vocabulary has tokens across a space behind other than white space."""
    with open(path_a) as f:
        a = json.load(f)
    model, _, mark = pieces(path_b)
    pre = a.get("pre_tokenizer") or {}
    ends = not a.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    reach = any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i))
    return bool(ends) and not reach and not model.is_unknown(mark)


#: Characters of white space, by the length of their UTF-8 form; a text is not split after any of them.
SPACES = {n: {c for c in (chr(i).encode() for i in range(0x3001) if chr(i).isspace()) if len(c) == n} for n in (1, 2, 3)}


def segments(texts: pa.Array, cut: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(segments, how many each text has): of a space and the text, to which they join. A null or empty text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    big = lambda v: pa.scalar(v, pa.large_string())
    data, offs = raw(pc.if_else(pc.equal(pc.binary_length(texts), 0), big(""), pc.binary_join_element_wise(big(""), texts, big(" "))))
    at = np.flatnonzero(data[1:] == 32) + 1 if cut else np.zeros(0, np.int64)
    before = data[at - 1]
    ok = ~np.isin(before, [c[0] for c in SPACES[1]])
    for n in (2, 3):
        for c in SPACES[n]:
            same = (before == c[-1]) & (at >= n)
            for k in range(2, n + 1):
                same[same] = data[at[same] - k] == c[-k]
            ok &= ~same
    begin = np.union1d(at[ok], offs[:-1][np.diff(offs) > 0])
    counts = np.diff(np.searchsorted(begin, offs))
    ends = np.r_[begin, len(data)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]), counts


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ends): each link of tokens of A and B that lie along the same bytes, with their sizes in order, and whether both
    tokens end with it. Ends of either cut bytes into stretches; two tokens that overlap have one stretch in common."""
    a, b = np.cumsum(size_a), np.cumsum(size_b)
    every = np.union1d(a, b)
    i, j = np.searchsorted(a, every), np.searchsorted(b, every)
    return i, j, (a[i] == every) & (b[j] == every)


class Tokens:
    """Ids of many segments, as :func:`tokenise` stores them behind four bytes, with tokens' sizes in bytes by id."""

    def __init__(self, rows: pa.Array, size_a: np.ndarray, size_b: np.ndarray):
        kind = _kind(len(size_a), len(size_b))
        offs = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        data = np.frombuffer(bytes(rows.buffers()[2] or b"")[offs[0] : offs[-1]], np.uint8)
        own = np.ones(len(data), bool)
        own[(offs[:-1, None] - offs[0] + np.arange(4)).ravel()] = False
        data = data[own].view(kind).astype(np.int64)
        first = (offs - offs[0] - 4 * np.arange(len(offs))) // kind.itemsize
        held = np.diff(first) > 0
        self.ok, n = held, len(rows)
        self.na = np.zeros(n, np.int64)
        self.na[held] = data[first[:-1][held]] + (data[first[:-1][held] + 1] << 16)
        self.nb = np.where(held, np.diff(first) - 2 - self.na, 0)
        place = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first)) - 2
        many = np.repeat(self.na, np.diff(first))
        self.a, self.b = data[(place >= 0) & (place < many)], data[place >= many]
        i, j, ends = overlaps(size_a[self.a], size_b[self.b])
        owner = np.repeat(np.arange(n), self.na)[i]
        self.pairs = self.a[i] << 32 | self.b[j]
        self.nl, self.ng = np.bincount(owner, minlength=n), np.bincount(owner[ends], minlength=n)
        self._cut = i[ends] + 1, j[ends] + 1

    def groups(self) -> pa.Array:
        """Of each segment, ``a1,a2|b1;a3|b2``."""
        ids = [_joined(pa.array(v).cast(pa.string()), np.r_[0, cut], ",") for v, cut in zip((self.a, self.b), self._cut, strict=True)]
        return _joined(pc.binary_join_element_wise(*ids, "|"), np.r_[0, np.cumsum(self.ng)], ";")


def _joined(texts: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    """Stretches of texts, each as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), between)


def _kind(*sizes: int) -> np.dtype:
    """Numbers in which ids of vocabularies of these sizes are stored."""
    return np.dtype("<u2" if max(sizes) <= 1 << 16 else "<u4")


def _sizes(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(list(map(len, t))) for t in (byte_level(path_a)[1], pieces(path_b)[1]))


def tokenise(segs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(seg, tokens) of segments: the number of A's ids in two halves, A's ids and B's; empty where the joined bytes of either's
    tokens aren't the segment's."""
    kind = _kind(*map(len, _sizes(path_a, path_b))).char

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, bytes_a = byte_level(path_a)
        model, bytes_b, mark = pieces(path_b)
        for batch in batches:
            for _, part in blocks(batch.column(0), 200_000):
                own = part.to_pylist()
                ids_a = [e.ids for e in tok.encode_batch_fast(own, add_special_tokens=False)]
                ids_b = [x if s != " " else [mark] for s, x in zip(own, model.encode([s[1:] for s in own], num_threads=1), strict=True)]
                out = []
                for s, a, b in zip(own, ids_a, ids_b, strict=True):
                    same = b"".join([bytes_a[i] for i in a]) == s.encode() == b"".join([bytes_b[i] for i in b])
                    out.append(array(kind, [len(a) & 0xFFFF, len(a) >> 16, *a, *b]).tobytes() if same else b"")
                yield pa.RecordBatch.from_arrays([part, pa.array(out, pa.binary())], names=["seg", "tokens"])
        release()

    return segs.mapInArrow(run, "seg string, tokens binary")


def _chunks(docs: DataFrame, cut: bool) -> DataFrame:
    """(grp, keys, starts, codes, segs): documents in chunks; document i has the segments ``codes[starts[i]:starts[i + 1]]`` of
    its group's table ``segs``, which is a row of its own behind the group's chunks."""
    ddl = f"grp long, keys array<{docs.schema['key'].dataType.simpleString()}>, starts binary, codes binary, segs array<string>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    def row(grp: int, **have: pa.Array) -> pa.RecordBatch:
        have["grp"] = pa.array([grp])
        return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(1, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]] = []
        size, total, grp = 0, 0, TaskContext.get().partitionId() << 24

        def encoded() -> tuple[pa.Array, np.ndarray, pa.DictionaryArray]:
            keys, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in range(2))
            segs, counts = segments(texts, cut)
            return keys, np.r_[0, np.cumsum(counts)], segs.dictionary_encode()

        def group() -> Iterator[pa.RecordBatch]:
            codes = pa.chunked_array([d[2] for d in done]).unify_dictionaries()
            for (keys, starts, _), own in zip(done, codes.chunks, strict=True):
                yield row(grp, keys=one(keys), starts=pa.array([_packed(starts)], pa.binary()), codes=pa.array([_packed(own.indices.to_numpy())], pa.binary()))
            yield row(grp, segs=one(codes.chunk(0).dictionary))

        for batch in batches:
            for at, texts in blocks(batch.column(1), CHUNK):
                held.append(batch.slice(at, len(texts)))
                size += len(raw(texts)[0])
                if size >= CHUNK:
                    done.append(encoded())
                    held, size, total = [], 0, total + size
                    if total >= GROUP:
                        yield from group()
                        done, total, grp = [], 0, grp + 1
                    release()
        if held:
            done.append(encoded())
        if done:
            yield from group()
        release()

    return docs.mapInArrow(run, ddl)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, first bytes first, then second ones, compressed."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, table) of a chunk's row."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    return *(_unpacked(get(c)[i]) for c in ("starts", "codes")), get("table").slice(i, 1).flatten()


def _composed(rows: DataFrame, key: str, full: bool, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Chunks with what their documents' segments give; a chunk's pairs of ids with the number of documents that hold each; and
    the pairs of each segment's links."""
    own = f"chunk long, keys array<{key}>, starts binary, codes binary, counts binary, links binary, na array<long>, nb array<long>, ng array<long>, nl array<long>, sha array<string>, groups array<string>, a array<int>, b array<int>, n array<long>"
    schema = to_arrow_schema(StructType.fromDDL(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_level.cache_clear()  # a worker that has tokenised before needs them no more
        pieces.cache_clear()
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                made = compose(*_opened(batch, i), *sizes)
                row = {c: batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in ("chunk", "keys", "starts")}
                row |= {c: pa.array([v], schema.field(c).type) for c, v in made.items()}
                yield pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in schema], schema=schema)
                del row, made
                release()

    def compose(starts: np.ndarray, codes: np.ndarray, table: pa.Array, size_a: np.ndarray, size_b: np.ndarray) -> dict:
        own = np.unique(codes)  # of the group's segments, the chunk's
        codes = np.searchsorted(own, codes)
        tokens = Tokens(table.take(pa.array(own)), size_a, size_b)
        n, many = len(starts) - 1, len(own)
        owner = np.repeat(np.arange(n), np.diff(starts))
        good = np.bincount(owner, ~tokens.ok[codes], n) == 0
        total = lambda v: np.where(good, np.diff(np.r_[0, np.cumsum(v[codes])][starts]), 0)
        texts = tokens.groups()
        sha: list[str] = []
        groups: list[str] | None = [] if full else None
        # documents that hold a pair: of the different segments of each document
        pair, code = np.unique(tokens.pairs, return_inverse=True)
        first = np.r_[0, np.cumsum(tokens.nl)]
        count = np.zeros(len(pair), np.int64)
        at_doc = 0
        while at_doc < n:  # some documents at a time
            til = max(at_doc + 1, int(np.searchsorted(starts, starts[at_doc] + 200_000, "right")) - 1)
            part = slice(starts[at_doc], starts[til])
            whole = _joined(texts.take(pa.array(codes[part])), starts[at_doc : til + 1] - starts[at_doc], ";")
            for text, g in zip(whole, good[at_doc:til].tolist(), strict=True):
                data = text.as_buffer() if g else b""
                sha.append(hashlib.sha256(data).hexdigest() if len(data) else "")
                if full:
                    groups.append(text.as_py() if g else "")
            keep = good[owner[part]]
            both = np.unique((owner[part][keep] - at_doc) * max(1, many) + codes[part][keep])
            doc, seg = both // max(1, many), both % max(1, many)
            links = tokens.nl[seg] if many else seg
            at = np.repeat(first[seg] - np.r_[0, np.cumsum(links)[:-1]], links) + np.arange(links.sum()) if len(seg) else seg
            count += np.bincount(np.unique(np.repeat(doc, links) * max(1, len(pair)) + code[at]) % max(1, len(pair)), minlength=len(pair))[: len(pair)]
            at_doc = til
        return {"codes": _packed(codes), "counts": _packed(tokens.nl), "links": _packed(code), "na": total(tokens.na), "nb": total(tokens.nb), "ng": total(tokens.ng), "nl": total(tokens.nl), "sha": sha, "groups": groups, "a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": count}

    return rows.mapInArrow(run, own)


def _gathered(parts: DataFrame, key: str, row: Column) -> DataFrame:
    """(key, table): what each group's segments, or each chunk's pairs, have, in their order; as many as it has."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("table"))


def _with(chunks: DataFrame, key: str, tables: DataFrame) -> DataFrame:
    return chunks.join(tables, key, "left").withColumn("table", F.coalesce("table", F.array().cast(tables.schema["table"].dataType)))


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with ``full`` also groups: a row for each of ``df``.

    A is the byte-level vocabulary at ``path_a``, of a space and the text; B the vocabulary of pieces at ``path_b``, which adds
    that space itself. Tokens' bytes are laid side by side; places where tokens of both end cut them into groups, written
    ``a1,a2|b1;a3|b2``. A link is a token of A and one of B that overlap. The count of a pair of ids is the number of rows that
    hold it linked; n_best: links whose pair has the highest count of its A id, ties included; count_sum: counts over links.
    Null and empty texts, and texts whose tokens don't give back their bytes (as those with U+2581), have no tokens: zeros and
    an empty string. Rows that repeat a key, or have none, are rows of their own. Other columns of ``df`` are left out.
    Memory holds a chunk of texts, or one longer text, and its group's segments.
    """
    scratch = Scratch(df.sparkSession, "alignment")
    docs = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    chunks = scratch.keep(_chunks(docs, splits(path_a, path_b)).withColumn("chunk", F.monotonically_increasing_id()), "chunks", STORED)
    tables = chunks.where("segs is not null")
    different = tables.select(F.explode("segs").alias("seg")).distinct()
    table = scratch.keep(tokenise(different, path_a, path_b), "tokens", STORED)
    place = F.unhex(F.lpad(F.hex("pos"), 8, "0"))  # sorts as numbers do
    own = tables.select("grp", F.posexplode("segs").alias("pos", "seg")).join(table, "seg").select("grp", F.concat(place, "tokens").alias("r"))
    found = scratch.keep(_gathered(own, "grp", F.col("r")), "found", STORED)  # a write of its own: its shuffles go before the next
    scratch.drop("tokens")
    texts = chunks.where("keys is not null").select("grp", "chunk", "keys", "starts", "codes")
    done = scratch.keep(_composed(_with(texts, "grp", found), kind, full, _sizes(path_a, path_b)), "composed", STORED | {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH})
    scratch.drop("chunks", "found")
    counts = scratch.keep(done.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n")), "counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A's vocabulary has ids
    worth = counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("top"))
    pairs = done.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p")).select("chunk", "pos", "p.a", "p.b").join(worth, ["a", "b"])
    return _summed(_with(done.drop("a", "b", "n"), "chunk", _gathered(pairs, "chunk", F.struct("pos", "n", "top"))), key, kind, full)


def _summed(rows: DataFrame, key: str, kind: str, full: bool) -> DataFrame:
    names = ["keys", "na", "nb", "ng", "nl", "best", "total", "sha", *(["groups"] if full else [])]
    ddl = f"keys {kind}, na long, nb long, ng long, nl long, best long, total long, sha string" + (", groups string" if full else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts, codes, table = _opened(batch, i)
                row = {n: batch.column(batch.schema.get_field_index(n)).slice(i, 1).flatten() for n in names if n not in ("best", "total")}
                counts, links = (_unpacked(batch.column(batch.schema.get_field_index(c))[i]) for c in ("counts", "links"))
                first = np.r_[0, np.cumsum(counts)]
                for name, field in (("best", "top"), ("total", "n")):
                    v = table.field(field).to_numpy(zero_copy_only=False).astype(np.int64)
                    v = np.diff(np.r_[0, np.cumsum(v[links])][first])  # of each segment
                    row[name] = pa.array(np.where(row["na"].to_numpy() > 0, np.diff(np.r_[0, np.cumsum(v[codes])][starts]), 0))
                yield pa.RecordBatch.from_arrays([row[n].cast(f.type) for n, f in zip(names, schema, strict=True)], schema=schema)

    out = rows.mapInArrow(run, ddl)
    renamed = zip(names, [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"], strict=False)
    return out.select(*[F.col(a).alias(b) for a, b in renamed])
