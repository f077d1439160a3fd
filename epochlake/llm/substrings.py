"""Substring dedup: words that a window of consecutive words covers which also stands in an earlier document.

Documents are cut into segments: stretches of windows with one anchor, the run of ``ANCHOR`` words in a window that is least by
an order of hashes. A window's anchor follows from its words, so equal windows of all documents meet in the shard of their
anchor, each window in one segment only. A shard indexes the different segments that it holds (see :mod:`fm_index`), then its
segments are streamed against the index from last word to first: where the matching statistic reaches a window's length, the
documents of the suffixes in range tell whether an earlier one has it. Work is in proportion to words; no document meets
another but through an anchor.

Texts are stored in compressed chunks. A first pass sends each chunk's anchors alone: only segments whose anchor another
document has too go to a shard. Equal segments of a chunk are sent once, for its least document with them; its other documents
have an earlier one for all windows right there. So a group of copies costs a row for each chunk, not for each copy. Anchors
that many documents share come last in the order (from a bounded sample; it moves windows between shards and changes no
result), so that a line common to many texts doesn't bring all their segments to one shard.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .shared import Scratch, release
from .words import blocks, find, hashes, mix, raw, runs

WINDOW, ANCHOR = 13, 5
#: Bytes of texts that a chunk has at most, but for a single longer text, and of segments from which an index is made.
CHUNK, SHARD = 8_000_000, 2_500_000
#: Documents sampled for the order of anchors, the share of them from which an anchor comes last, and how many do at most.
SAMPLE, SHARE, LAST = 2_000, 0.005, 200_000
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_HIGH = np.uint64(1 << 63)
SEGMENTS = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("i", pa.int32()), ("doc", pa.int64()), ("at", pa.binary()), ("til", pa.binary()), ("text", pa.string())])
HITS = pa.schema([("chunk", pa.int64()), ("i", pa.int32()), ("at", pa.binary()), ("til", pa.binary())])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, number, first): of each word, unchanged; first: by text, the index of its first word, and the end. In
    blocks, as hashing takes some numbers for each byte."""
    data, offs = raw(texts)
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(1, np.int64))]
    n = 0
    for at, part in blocks(texts):
        base, end = offs[at], offs[at + len(part)]
        s, e, first = find(data[base:end], offs[at : at + len(part) + 1] - base)
        parts.append((s + base, e + base, hashes(_PLAIN[data[base:end]], s, e), first[1:] + n))
        n += len(s)
    s, e, h, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    return data, s, e, h, first


def anchors(h: np.ndarray, first: np.ndarray, size: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, text) of each window of ``size`` words within a text, by its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run, _ = runs(h, np.array([0, len(h)]), ANCHOR)  # over text ends too; windows that reach over one are left out below
    run >>= np.uint64(1)
    if len(last):
        near = np.minimum(np.searchsorted(last, run), len(last) - 1)
        run[last[near] == run] |= _HIGH
    least = run[:n].copy()
    for k in range(1, size - ANCHOR + 1):
        np.minimum(least, run[k : n + k], out=least)
    whole = np.flatnonzero(text[:n] == text[size - 1 :])
    return least[whole], whole, text[whole]


def spans(flags: np.ndarray, apart: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, group) of stretches of words that flagged windows cover; windows follow each other in groups ``apart``."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    new = np.r_[True, (np.diff(hit) > 1) | (apart[hit[1:]] != apart[hit[:-1]])]
    first = hit[new]
    end = hit[np.r_[np.flatnonzero(new)[1:], len(hit)] - 1] + size
    return first, end, apart[first]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers of each row as bytes."""
    data = pa.py_buffer(values.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.r_[0, 4 * np.cumsum(counts)].astype(np.int32).tobytes()), data])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts): the inverse of :func:`_binaries`."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return np.frombuffer(data.tobytes(), np.int32).astype(np.int64), np.diff(offs) // 4


def _chunks(docs: DataFrame) -> DataFrame:
    """(keys, docs, ends, texts): chunks of documents; docs, ends: 64-bit numbers, texts: compressed."""
    ddl = f"keys array<{docs.schema['key'].dataType.simpleString()}>, docs binary, ends binary, texts binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, doc, text = (pa.concat_arrays([b.column(c) for b in held]) for c in range(3))
            data, ends = raw(text)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *[pa.array([x], pa.binary()) for x in (doc.to_numpy().tobytes(), ends.tobytes(), zstandard.ZstdCompressor(3).compress(data))]]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for at, texts in blocks(batch.column(2), CHUNK):
                held.append(batch.slice(at, len(texts)))
                size += len(raw(texts)[0])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
                    release()
        if held:
            yield flush()
        release()

    return docs.mapInArrow(run, ddl)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, pa.Array]:
    """(chunk, docs, texts) of a stored chunk."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))[i]
    doc, ends = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("docs", "ends"))
    data = zstandard.ZstdDecompressor().decompress(get("texts").as_buffer(), max_output_size=int(ends[-1]) or 1)
    return get("chunk").as_py(), doc, pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _cuts(h: np.ndarray, first: np.ndarray, size: int, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, text, first word, end) of each segment."""
    anchor, at, text = anchors(h, first, size, last)
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
    return anchor[begin], text[begin], at[begin], at[np.r_[begin[1:], len(at)] - 1] + size if len(at) else at


def shares(chunk: int, doc: np.ndarray, texts: pa.Array, size: int, last: np.ndarray) -> pa.RecordBatch:
    """(key, chunk, lo, hi): a chunk's anchors, with the least and the greatest document that has each."""
    _, _, _, h, first = word_hashes(texts)
    key, text, _, _ = _cuts(h, first, size, last)
    own = doc[text]
    by = np.lexsort((own, key))
    key, own = key[by].view(np.int64), own[by]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[begin[1:], len(key)] - 1
    return pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.array(np.full(len(begin), chunk)), pa.array(own[begin]), pa.array(own[ends[: len(begin)]])], names=["key", "chunk", "lo", "hi"])


def cut(chunk: int, doc: np.ndarray, texts: pa.Array, size: int, last: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments of a chunk with anchors in ``shared`` as rows of SEGMENTS: each once for the chunk's least document with it, at
    all its places there. Places of other documents, which are found already, are rows without text."""
    data, s, e, h, first = word_hashes(texts)
    key, own, a, til = _cuts(h, first, size, last)
    keep = np.isin(key.view(np.int64), shared)
    if not keep.any():
        return
    key, own, a, til = key[keep], own[keep], a[keep], til[keep]
    same = hashes(h, a, til)
    by = np.lexsort((a, own, doc[own], same, key))
    key, same, a, til, own = key[by], same[by], a[by], til[by], own[by]
    new = np.r_[True, (key[1:] != key[:-1]) | (same[1:] != same[:-1])]
    mine = doc[own] == doc[own][np.flatnonzero(new)][np.cumsum(new) - 1]
    k, sm, o, x, y = key[mine], same[mine], own[mine], a[mine], til[mine]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (sm[1:] != sm[:-1]) | (o[1:] != o[:-1])])
    counts = np.diff(np.r_[head, len(k)])
    lo, hi, base, blob = s[x[head]], e[y[head] - 1], first[o], data.tobytes()
    for i in range(0, len(head), 20_000):
        part = slice(i, i + 20_000)
        rows = slice(head[i], head[i + 20_000] if i + 20_000 < len(head) else len(k))
        of = o[head[part]]
        columns = [pa.array(k[head[part]].view(np.int64)), pa.array(np.full(len(of), chunk)), pa.array(of, pa.int32()), pa.array(doc[of]), _binaries((x - base)[rows], counts[part]), pa.nulls(len(of), pa.binary()), pa.array([blob[u:v].decode() for u, v in zip(lo[part], hi[part], strict=True)], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=SEGMENTS)
    rest = np.flatnonzero(~mine)
    if len(rest):
        rest = rest[np.argsort(own[rest], kind="stable")]
        o = own[rest]
        head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        counts, of, base = np.diff(np.r_[head, len(o)]), o[head], first[o]
        columns = [pa.array(mix(of.astype(np.uint64) + np.uint64(chunk)).view(np.int64)), pa.array(np.full(len(of), chunk)), pa.array(of, pa.int32()), pa.array(doc[of]), _binaries(a[rest] - base, counts), _binaries(til[rest] - base, counts), pa.nulls(len(of), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=SEGMENTS)


def search(table: pa.Table, size: int) -> pa.RecordBatch | None:
    """Rows of HITS: what of a shard's segments an earlier document has too. The shard's keys are whole."""
    key, doc = table["key"].to_numpy(), table["doc"].to_numpy()
    _, _, _, h, first = word_hashes(table["text"].combine_chunks())
    same = hashes(h, first[:-1], first[1:])
    by = np.lexsort((doc, same, key))
    new = np.r_[True, (key[by][1:] != key[by][:-1]) | (same[by][1:] != same[by][:-1])]
    one = np.empty(len(by), np.int64)  # the segment that a row has
    one[by] = np.cumsum(new) - 1
    pick = by[new]  # of each segment, a row of its least document
    lengths = np.diff(first)[pick]
    ends = np.cumsum(lengths + 1)
    place = np.repeat(first[pick] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    symbol = np.unique(h[place], return_inverse=True)[1] + 1
    text = np.zeros(int(ends[-1]), np.int64)
    text[np.delete(np.arange(len(text)), ends - 1)] = symbol
    index = FMIndex(text, size)
    stream = np.r_[0, np.cumsum(lengths)]
    matched, found = index.matching_statistics(symbol, stream)
    of = np.repeat(np.arange(len(pick)), lengths + 1)  # the segment of each place of the index
    earliest = np.minimum.reduceat(doc[pick][of[index.places]], index.groups(size)[1][:-1])
    windows = (lengths - size + 1)[one]  # of each row
    back = np.repeat(stream[one] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(one)), windows)
    a, b, owner = spans((matched[back] >= size) & (earliest[found[back]] < doc[owner]), owner, size)
    if not len(a):
        return None
    base = np.r_[0, np.cumsum(windows)]
    a, b = a - base[owner], b - base[owner]
    places, counts = _numbers(table["at"].combine_chunks())
    often = counts[owner]
    at = places[np.repeat(np.r_[0, np.cumsum(counts)][owner] - np.r_[0, np.cumsum(often)[:-1]], often) + np.arange(often.sum())]
    owner, a, b = np.repeat(owner, often), np.repeat(a, often) + at, np.repeat(b, often) + at
    chunk, i = table["chunk"].to_numpy(), table["i"].to_numpy()
    by = np.lexsort((i[owner], chunk[owner]))
    owner, a, b = owner[by], a[by], b[by]
    head = np.flatnonzero(np.r_[True, (chunk[owner][1:] != chunk[owner][:-1]) | (i[owner][1:] != i[owner][:-1])])
    counts = np.diff(np.r_[head, len(owner)])
    return pa.RecordBatch.from_arrays([pa.array(chunk[owner[head]]), pa.array(i[owner[head]]), _binaries(a, counts), _binaries(b, counts)], schema=HITS)


def _order(docs: DataFrame) -> np.ndarray:
    """Anchors that at least a share of sampled documents has, sorted: these come last. A list of bounded length."""
    n = docs.count()
    few = docs.select("text") if n <= SAMPLE else docs.select("text").sample(SAMPLE / n, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column(0), CHUNK):
                _, _, _, h, first = word_hashes(texts)
                run, _ = runs(h, np.array([0, len(h)]), ANCHOR)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                m = max(0, len(text) - ANCHOR + 1)
                inside = text[:m] == text[ANCHOR - 1 :][:m]
                key, own = run[:m][inside] >> np.uint64(1), text[:m][inside]
                by = np.lexsort((own, key))
                key, own = key[by], own[by]
                new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(key)]
                key, count = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    least = max(8, SHARE * min(n, SAMPLE))
    found = few.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(LAST)
    return np.sort(np.array([r.key for r in found.select("key").toLocalIterator()], np.int64).view(np.uint64))


def repeated(chunks: DataFrame, last: np.ndarray, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """(chunk, i, at, til): stretches of words of document i of a chunk, from ``at`` to before ``til``, that windows of ``size``
    words cover which also stand in a text with a smaller doc."""
    wide = chunks.sparkSession.sparkContext.broadcast(last)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shares(*_opened(batch, i), size, wide.value)
                for at in range(0, found.num_rows, 100_000):
                    yield found.slice(at, 100_000)
                release()

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shared = batch.column(batch.schema.get_field_index("shared")).slice(i, 1).flatten().to_numpy()
                yield from cut(*_opened(batch, i), size, wide.value, shared)
                release()

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            known = np.asarray(batch.column(6).is_null())
            if known.any():
                yield batch.filter(pa.array(known)).select(HITS.names)
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                change = np.r_[0, change]
            if bytes_held >= SHARD and len(change):  # keys are whole up to the last change
                if change[-1]:
                    held.append(batch.slice(0, int(change[-1])))
                if (found := search(pa.Table.from_batches(held), size)) is not None:
                    yield found
                held, bytes_held, batch = [], 0, batch.slice(int(change[-1]))
                release()
            held.append(batch)
            bytes_held += batch.nbytes
        if held and (found := search(pa.Table.from_batches(held), size)) is not None:
            yield found
        release()

    both = Window.partitionBy("key")
    keys = chunks.select("chunk", "docs", "ends", "texts").mapInArrow(anchored, "key long, chunk long, lo long, hi long")
    common = keys.select("key", "chunk", F.min("lo").over(both).alias("lo"), F.max("hi").over(both).alias("hi")).where("lo < hi")
    shared = scratch.keep(common.groupBy("chunk").agg(F.collect_list("key").alias("shared")), "shared")
    rows = chunks.select("chunk", "docs", "ends", "texts").join(shared, "chunk").mapInArrow(cuts, "key long, chunk long, i int, doc long, at binary, til binary, text string")
    return scratch.keep(rows.repartition("key").sortWithinPartitions("key").mapInArrow(hits, "chunk long, i int, at binary, til binary"), "hits")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW, full: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256), with ``full`` also kept (the words left, joined by one space): a row for each of
    ``df``.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. Removed is each word that a window of
    ``size`` consecutive words covers which also stands in a document with a smaller key; windows are of the texts as given. A
    null text counts as empty, and texts with fewer words than a window lose none. Keys are whole numbers; null ones come after
    all others, and rows with equal keys, null ones too, take nothing from each other. Words are told apart by 64-bit hashes.
    Other columns of ``df``, whatever their names, are left out. Memory holds a chunk of texts or one longer text, and the
    different segments of one anchor.
    """
    scratch = Scratch(df.sparkSession, "substrings")
    docs = df.select(df[key].alias("key"), F.coalesce(df[key].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))
    chunks = scratch.keep(_chunks(docs).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    found = repeated(chunks, _order(docs), scratch, size).groupBy("chunk").agg(F.collect_list(F.struct("i", "at", "til")).alias("spans"))
    kind = docs.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if full else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from left(batch, i)
                release()

    def left(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        _, doc, texts = _opened(batch, i)
        spans = batch.column(batch.schema.get_field_index("spans")).slice(i, 1).flatten()
        gone: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at in range(len(spans)):
            row = spans[at]
            gone.setdefault(row["i"].as_py(), []).append(tuple(np.frombuffer(row[c].as_buffer(), np.int32) for c in ("at", "til")))
        keys = batch.column(batch.schema.get_field_index("keys")).slice(i, 1).flatten()
        for begin in range(0, len(doc), 1000):
            out: list[tuple] = []
            for j, t in enumerate(texts.slice(begin, 1000), begin):
                words = _WORD.findall(t.as_buffer())
                n = len(words)
                if j in gone:
                    cover = np.zeros(n + 1, np.int64)
                    for a, b in gone[j]:
                        np.add.at(cover, a, 1)
                        np.add.at(cover, b, -1)
                    words = [words[x] for x in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if full else [])))
            columns = [keys.slice(begin, 1000), *[pa.array(list(c)) for c in zip(*out, strict=True)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return chunks.join(found, "chunk", "left").mapInArrow(run, ddl).withColumnRenamed("key", key)
