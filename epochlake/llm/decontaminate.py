"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words. TF-IDF vectors of passages are projected on the leading singular
vectors of the matrix of all half passages, which a randomised SVD finds, and passages near to one of the benchmark by
cosine are candidates. A candidate is contaminated if the longest common subsequence of words covers enough of the item,
or somewhat less of it together with the item's answer.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, release
from .words import LOOSE, blocks, words

#: Words of half a passage; passages overlap by as much.
HALF = 16
#: Slots that words are hashed to; singular vectors kept, and random directions beyond them.
SLOTS, RANK, EXTRA = 1 << 15, 96, 16
#: Parts in which products are added up before the driver gets them.
PARTS = 256
#: Words whose part of a product a task adds up at once, and rows that one step of adding takes.
WORDS, STEP = 1_000_000, 1_024
#: Parts of the documents that a task of a product takes, where there are that many for each core: its result has one size.
SPLITS = 32
#: Part of the cosine that a whole copy of an item has in the worst alignment, from which a passage is a candidate.
NEAR = 0.5
#: Share of the item's words in the longest common subsequence: enough by itself, and enough with its answer.
COPIED, SIMILAR = 0.8, 0.6
#: Words of an item below which it is searched nowhere: fewer stand in order in many a text by chance.
LEAST = 8
#: Numbers of 64 bits in which the words of a half passage, or an item, are marked.
LANES = 8
#: Passages of texts, and of items, whose cosines are made at once.
ROWS, COLUMNS = 2_048, 8_192
#: Where items have no answer of their own, so many last words are taken as it; found if half of them or more are there.
ANSWER = 4
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark is searched in slices.
SLICE = 16 << 20


def halves(first: np.ndarray, half: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of each run of up to ``half`` words: where it begins among all words, and whose it is."""
    counts = np.diff(first)
    n = -(-counts // half)
    text = np.repeat(np.arange(len(counts)), n)
    return first[text] + half * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)), text


def sums(table: np.ndarray, slot: np.ndarray, start: np.ndarray, half: int = HALF) -> np.ndarray:
    """Sums of the rows of ``table`` at the slots of each run of up to ``half`` from ``start``; the table's last row is 0."""
    sizes = np.diff(np.append(start, len(slot)))
    none, out, row = len(table) - 1, None, np.empty((len(start), table.shape[1]), table.dtype)
    for k in range(half):
        at = np.where(k < sizes, slot[np.minimum(start + k, len(slot) - 1)], none)
        if out is None:
            out = table[at]
        else:
            out += np.take(table, at, axis=0, out=row, mode="clip")
    return out


def gathered(table: np.ndarray, rows: np.ndarray, first: np.ndarray, run: int = 64) -> np.ndarray:
    """Sums of the rows of ``table`` that ``rows`` names, for each group of those from ``first`` on; no group is empty."""
    sizes = np.diff(np.append(first, len(rows)))
    n = -(-sizes // run)
    if len(n) and n.max() > 1:
        start, _ = halves(np.append(first, len(rows)), run)
        return gathered(gathered(table, rows, start, run), np.arange(len(start)), np.cumsum(n) - n, run)
    # groups of like sizes together, so few that the sums stay in the cache
    order = np.argsort(-sizes, kind="stable")
    out, row = np.empty((len(sizes), table.shape[1]), table.dtype), np.empty((STEP, table.shape[1]), table.dtype)
    for b in range(0, len(order), STEP):
        own = order[b : b + STEP]
        at, left = first[own], -sizes[own]
        some = table[rows[at]]
        for k in range(1, -int(left[0])):
            m = int(np.searchsorted(left, -k))
            some[:m] += np.take(table, rows[at[:m] + k], axis=0, out=row[:m], mode="clip")
        out[own] = some
    return out


class Product:
    """A'A q, where A has a row of counts of slots for each half passage added: for each slot the sum over its words of the
    half passage's row of A q. Rows of A q are made at once, and added to their slots for many words at a time."""

    def __init__(self, q: np.ndarray):
        self.q, self.sums = q, np.zeros(q.shape)
        self.slots, self.rows, self.made, self.words = [], [], [], 0

    def add(self, h: np.ndarray, first: np.ndarray) -> None:
        if not len(h):
            return
        slot = (h % np.uint64(SLOTS)).astype(np.uint16)
        start, _ = halves(first)
        below = sum(map(len, self.made))
        self.rows.append(np.repeat(np.arange(below, below + len(start), dtype=np.int32), np.diff(np.append(start, len(h)))))
        self.slots.append(slot)
        self.made.append(gathered(self.q, slot, start))
        self.words += len(h)
        if self.words >= WORDS:
            self.flush()

    def flush(self) -> None:
        if self.words:
            slot = np.concatenate(self.slots)
            order = np.argsort(slot, kind="stable")  # by radix, as these have 16 bits
            slot = slot[order]
            at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            self.sums[slot[at]] += gathered(np.concatenate(self.made), np.concatenate(self.rows)[order], at)
        self.slots, self.rows, self.made, self.words = [], [], [], 0

    def total(self) -> np.ndarray:
        self.flush()
        return self.sums


def passages(parts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sums of each row and the next of the same text; a text's last row by itself only if it is its only one."""
    out = parts.copy()
    both = text[1:] == text[:-1]
    out[:-1][both] += parts[1:][both]
    return out


def marks(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A bit for each word, united over each run from ``start``."""
    lanes = np.zeros((len(h), LANES), np.uint64)
    lanes[np.arange(len(h)), ((h >> np.uint64(6)) % np.uint64(LANES)).astype(np.int64)] = np.uint64(1) << (h & np.uint64(63))
    return np.bitwise_or.reduceat(lanes, start)


def around(marked: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """The marks of the half passages from ``reach`` before each to ``reach`` after the next, as far as the same text goes."""
    out = marked.copy()
    for k in range(1, min(reach + 1, len(text) - 1) + 1):
        same = (text[k:] == text[:-k])[:, None]
        out[:-k] |= np.where(same, marked[k:], 0)
        if k <= reach:
            out[k:] |= np.where(same, marked[:-k], 0)
    return out


def rarity(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(tasks, weight of each slot): how many read ``docs``; the logarithm of all half passages to those with the slot, over
    all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                h, first = words(texts, LOOSE, True)
                start, _ = halves(first)
                n += len(start)
                where = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
                keys = np.sort(where * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64))
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
                table += np.bincount(keys % SLOTS, minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([n]), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["tasks", "n", "data"])

    def total(group: pa.Table) -> pa.Table:
        table = np.zeros(SLOTS, np.int64)
        for data in group["data"]:
            table += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
        return pa.table({"tasks": [sum(group["tasks"].to_pylist())], "n": [sum(group["n"].to_pylist())], "data": [zlib.compress(table.tobytes(), 1)]}, pa.schema([("tasks", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

    kind = "tasks bigint, n bigint, data binary"
    made = docs.select(docs[text].alias("text")).mapInArrow(add, kind)
    some = made.groupBy(F.expr("spark_partition_id() div 64").alias("s")).applyInArrow(total, kind)  # in two steps of 64 tables
    rows = some.groupBy(F.expr("spark_partition_id() div 64").alias("s")).applyInArrow(total, kind).collect()
    table, n = np.ones(SLOTS, np.int64), sum(r["n"] for r in rows)
    for r in rows:
        table += np.frombuffer(zlib.decompress(bytes(r["data"])), np.int64)
    return sum(r["tasks"] for r in rows), np.log1p(n / table).astype(np.float32)


def basis(fit: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(SLOTS, rank) leading right singular vectors of the TF-IDF matrix A of the half passages of ``fit`` (text), each divided
    by its singular value, so that what most passages have in common doesn't outweigh the rest in a cosine.

    Randomised: orthonormal directions Q are those of A'A times random ones; a second product A'A Q gives the small
    matrix Q'A'AQ, whose eigenvectors turn Q into the singular vectors. Products are made by tasks over their rows.
    """
    spark = fit.sparkSession

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q * weight[:, None])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Product(sent.value)
            for batch in batches:
                for _, texts in blocks(batch.column(0)):
                    made.add(*words(texts, LOOSE, True))
            out, task = made.total(), TaskContext.get().partitionId()
            for k, part in enumerate(np.split(out, PARTS)):
                if part.any():
                    arrays = [pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["part", "task", "data"])
            release()

        def add(group: pa.Table) -> pa.Table:
            out = np.zeros(SLOTS // PARTS * q.shape[1])
            for data in group.sort_by("task")["data"]:  # in one order, so that reruns agree
                out += np.frombuffer(data.as_py(), np.float32)
            return pa.table({"part": group["part"][:1], "data": [out.astype(np.float32).tobytes()]}, pa.schema([("part", pa.int32()), ("data", pa.binary())]))

        total = np.zeros(q.shape, np.float32)
        for r in fit.mapInArrow(run, "part int, task int, data binary").groupBy("part").applyInArrow(add, "part int, data binary").toLocalIterator():
            total[r["part"] * (SLOTS // PARTS) : (r["part"] + 1) * (SLOTS // PARTS)] = np.frombuffer(r["data"], np.float32).reshape(-1, q.shape[1])
        sent.destroy()
        total *= weight[:, None]
        return total

    # single precision and no copies to spare: this is the driver's memory
    rng = np.random.Generator(np.random.PCG64(7))
    q = np.linalg.qr(product(rng.standard_normal((SLOTS, rank + EXTRA), np.float32)))[0]
    z = product(q)
    small = (q.T @ z).astype(np.float64)
    del z
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    squares, turn = squares[::-1][:rank], turn[:, ::-1][:, :rank]
    scale = np.where(squares > 1e-6 * max(squares[0], 1e-12), 1 / np.sqrt(np.maximum(squares, 1e-12)), 0)
    out = q @ (turn * scale).astype(np.float32)
    del q
    release()
    return out


def masks(h: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(h):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(mask: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of the ``n`` words behind ``mask`` and the words ``other``, a bit for each word."""
    full = left = (1 << n) - 1
    for m in filter(None, map(mask.get, other)):
        u = left & m
        left = ((left + u) | (left - u)) & full
    return n - left.bit_count()


class Items:
    """A slice of the benchmark, ready to search for."""

    def __init__(self, rows: list[tuple[int, str, str | None]], table: np.ndarray):
        texts = pa.array([r[1] or "" for r in rows], pa.large_string())
        h, first = words(texts, LOOSE, True)
        keep = np.flatnonzero(np.diff(first) >= LEAST)
        self.ids = [rows[i][0] for i in keep]
        self.words = [h[first[i] : first[i + 1]].tolist() for i in keep]
        self.masks = [masks(w) for w in self.words]
        asked = words(pa.array([rows[i][2] or "" for i in keep], pa.large_string()), LOOSE, True)
        self.answers = [set(asked[0][a:b].tolist()) or set(w[-ANSWER:]) for w, a, b in zip(self.words, asked[1][:-1], asked[1][1:], strict=True)]
        vectors, self.item, least = [], [], []
        for n, w in enumerate(self.words):
            e = table[np.array(w, np.uint64) % np.uint64(SLOTS)]
            for at in sorted({*range(0, max(1, len(w) - 2 * HALF + 1), HALF), max(0, len(w) - 2 * HALF)}):
                part = e[at : at + 2 * HALF]
                vectors.append(part.sum(0))
                self.item.append(n)
                inside = min(len(part), HALF + max(0, len(part) - HALF) // 2)
                least.append(NEAR * inside / np.sqrt(len(part) * 2 * HALF))
        v = np.array(vectors, np.float32).reshape(len(vectors), table.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        self.least, self.item = np.array(least, np.float32), np.array(self.item, np.int64)
        # If a share of SIMILAR of an item's n words stands in a text, fewer than (1 - SIMILAR) n of its different words
        # don't, so the text lacks no more than so many of the item's marks, whatever words share a mark.
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.marks = np.array([marks(np.array(w, np.uint64), np.zeros(1, np.int64))[0] for w in self.words], np.uint64).reshape(len(sizes), LANES)
        self.enough = np.bitwise_count(self.marks).sum(1) - (1 - SIMILAR) * sizes - 1e-9
        self.reach = -(-sizes // HALF)


def search(h: np.ndarray, first: np.ndarray, table: np.ndarray, items: Items) -> list[tuple[int, int, float, float, bool, int]]:
    """(text, item, cosine, share, answered, word) of each text and item that pass: of its best passage, with where it begins."""
    if not len(h) or not items.ids:
        return []
    start, text = halves(first)
    p = passages(sums(table, (h % np.uint64(SLOTS)).astype(np.int64), start), text)
    p /= np.maximum(np.linalg.norm(p, axis=1), 1e-12)[:, None]
    marked = marks(h, start)
    wide: dict[int, np.ndarray] = {}
    best: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
    for at, right in itertools.product(range(0, len(p), ROWS), range(0, len(items.vectors), COLUMNS)):
        cosine = p[at : at + ROWS] @ items.vectors[right : right + COLUMNS].T
        near, to = np.nonzero(cosine >= items.least[right : right + COLUMNS])
        if not len(near):
            continue
        # each passage and item once, with the highest cosine
        values, of = cosine[near, to], items.item[right + to]
        key = near * len(items.ids) + of
        order = np.argsort(key, kind="stable")
        first_of = np.flatnonzero(np.diff(key[order], prepend=-1))
        near, of, values = near[order][first_of], of[order][first_of], np.maximum.reduceat(values[order], first_of)
        alike = np.zeros(len(near), bool)
        for reach in np.unique(items.reach[of]).tolist():
            if reach not in wide:
                wide[reach] = around(marked, text, reach)
            some = np.flatnonzero(items.reach[of] == reach)
            alike[some] = np.bitwise_count(wide[reach][at + near[some]] & items.marks[of[some]]).sum(1) >= items.enough[of[some]]
        for i, n, c in zip(near[alike].tolist(), of[alike].tolist(), values[alike].tolist(), strict=True):
            t = int(text[at + i])
            if (old := best.get((t, n))) and old[1] == 1:
                continue
            w = items.words[n]
            begin = int(start[at + i])
            lo, hi = max(int(first[t]), begin - len(w)), min(int(first[t + 1]), begin + 2 * HALF + len(w))
            region = h[lo:hi].tolist()
            share = common(items.masks[n], len(w), region) / len(w)
            if share >= SIMILAR and (old is None or share > old[1]):
                answer = items.answers[n]
                answered = 2 * len(answer.intersection(region)) >= len(answer)
                if share >= COPIED or answered:
                    best[t, n] = c, share, answered, begin - int(first[t])
    return [(t, n, *x) for (t, n), x in sorted(best.items())]


class Search:
    """What searching takes: singular vectors, as a broadcast of fixed size, and the benchmark in slices of at most SLICE bytes."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text: str, key: str, item: str, item_text: str, answer: str | None):
        self.spark = docs.sparkSession
        lean(self.spark)
        tasks, weight = rarity(docs, text)
        about = benchmark.agg(F.coalesce(F.sum(F.octet_length(benchmark[item_text])), F.lit(0)).alias("size")).first()
        fit = docs.select(docs[text].alias("text")).union(benchmark.select(benchmark[item_text].alias("text")))
        self.vectors = basis(fit.coalesce(max(self.spark.sparkContext.defaultParallelism, tasks // SPLITS)), weight) * weight[:, None]
        self.table = self.spark.sparkContext.broadcast(np.vstack([self.vectors, np.zeros((1, RANK), np.float32)]))
        self.slices = max(1, -(-int(about["size"]) // SLICE))
        self.asked = benchmark.select(benchmark[item].cast("long").alias("item_id"), benchmark[item_text].alias("text"), (benchmark[answer].cast("string") if answer else F.lit(None).cast("string")).alias("answer"))

    def items(self, s: int):
        own = self.asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.slices)) == s).collect()
        return self.spark.sparkContext.broadcast(Items([tuple(r) for r in sorted(own, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))], self.vectors))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """A row for each document and benchmark item that it contains: doc_id, item_id, cosine, share, answered, word.

    share: of the item's words, in the longest common subsequence with the words around the passage; a row has 0.8 or more,
    or 0.6 or more and half of the answer's words. word: where the passage begins in the text. Words are what ASCII
    punctuation and white space leave, in lower case. Null and empty texts, and items of fewer than 8 words, match nothing;
    rows that repeat a key are documents of their own, and so are rows with a null key. Documents are read four times
    (rarity, two products, search) and never shuffled. What is broadcast is of a fixed size, or a slice of the benchmark.
    """
    how = Search(docs, benchmark, text, key, item, item_text, answer)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    table = how.table

    def part(s: int) -> DataFrame:
        sent = how.items(s)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for at, texts in blocks(batch.column(1)):
                    found = search(*words(texts, LOOSE, True), table.value, items)
                    if found:
                        t, k, cosine, share, answered, word = zip(*found, strict=True)
                        arrays = [batch.column(0).take(pa.array([at + x for x in t])), pa.array([items.ids[x] for x in k], pa.int64()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(answered), pa.array(word, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "cosine", "share", "answered", "word"])

        return rows.mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, share double, answered boolean, word bigint")

    return functools.reduce(DataFrame.union, [part(s) for s in range(how.slices)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """``docs`` without the rows in which :func:`contaminated` finds an item, with all their columns. Each row is judged by its
    own text, whatever its key: nothing is joined or shuffled."""
    how = Search(docs, benchmark, text, key, item, item_text, answer)
    table, at_text, schema = how.table, docs.columns.index(text), docs.schema

    def part(left: DataFrame, s: int) -> DataFrame:
        sent = how.items(s)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, texts in blocks(batch.column(at_text)):
                    clean[[at + x[0] for x in search(*words(texts, LOOSE, True), table.value, items)]] = False
                yield batch.filter(pa.array(clean))
            release()

        return left.mapInArrow(run, schema)

    return functools.reduce(part, range(how.slices), docs)
