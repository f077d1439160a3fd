"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its runs of five words, weighted by TF-IDF: frequency in the text and rarity in the corpus. Consistent
weighted samples of two texts are equal with a chance of their weighted Jaccard similarity; bands of samples name
buckets, and pairs from buckets are verified by that similarity itself. As rarity would take from a large group of near
copies the shingles that make them alike, texts are weighted by frequency alone as well, and either similarity links.
Rows are told apart by a number of their own, never by their key.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, fresh
from .words import LOOSE, blocks, fold, hashes, mix, raw, runs, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Counters of documents by shingle: a fixed table of 4 MB; shingles that share one count together.
COUNTERS = 1 << 20
#: Logarithms of weights are rounded to whole parts of 1 / STEP, from LOW on: samples of all weights then come from a table.
STEP, LOW, LEVELS = 8, -4, 56
#: Draws that shingles share by 16 bits of their hash; equal draws are told apart by the shingle itself.
DRAWS = 1 << 16
#: Equal bytes of 64 in two texts' digests of samples below which a pair isn't verified: at similarity 0.8, 1 in 10^6 has fewer.
ALIKE = 35
#: Texts of a bucket up to which its pairs are made one by one; texts of a block in larger ones, and bytes of their sets.
FEW, BLOCK, BLOCK_BYTES = 24, 1024, 8 << 20
#: Weights that are compared at once.
GATHER = 1 << 20


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, times, first): the distinct shingles of each text, ascending in it, how often each stands there, and by text
    where its own begin (one more at the end).

    Words are what ASCII punctuation and white space leave, in lower case. A text with fewer than five is one shingle; one
    with none, but with other signs than white space, is one shingle of its bytes; a null or blank one has none.
    """
    data, offs = raw(texts)
    h, first = words(texts, LOOSE, True)
    found, text = runs(h, first, SHINGLE)
    bare = np.flatnonzero((np.diff(first) == 0) & (np.diff(offs) > 0))
    signs = np.array([i for i in bare if data[offs[i] : offs[i + 1]].tobytes().strip()], np.int64)
    if len(signs):
        found = np.concatenate([found, hashes(fold(data), offs[signs], offs[signs + 1])])
        text = np.concatenate([text, signs])
    if len(offs) > 2:  # texts in the top bits, so one sort does
        lead = max(1, int(len(offs) - 1).bit_length())
        short = found >> np.uint64(20)
        keys = np.sort((text.astype(np.uint64) << np.uint64(44)) | short) if lead <= 20 else None
        text, found = (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1)
    else:
        found = np.sort(found >> np.uint64(20))
        text = np.zeros(len(found), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])])) if len(found) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(found)))
    return found[new], times, np.searchsorted(text[new], np.arange(len(offs)))


def counters(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of documents, counters): in how many documents the shingles of each counter stand, over all documents.

    A task adds up its own table and passes it on in 64 parts, each first added up over 64 neighbouring tasks and then over
    all: a group gathers 64 parts of 128 kB, and at last one for each 64 tasks. What comes to the driver is one table.
    """
    parts, size = 64, COUNTERS // 64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in blocks(batch.column(0)):
                table += np.bincount((shingles(texts)[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if n:
            data = [zlib.compress(table[p * size : (p + 1) * size].tobytes(), 1) for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array(data, pa.binary())], names=["part", "n", "data"])

    def total(group: pa.Table) -> pa.Table:
        table = np.zeros(size, np.int64)
        for data in group["data"]:
            table += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
        n = sum(group["n"].to_pylist())
        return pa.table({"part": [group["part"][0].as_py()], "n": [n], "data": [zlib.compress(table.tobytes(), 1)]}, pa.schema([("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))

    kind = "part int, n bigint, data binary"
    made = rows.select("text").mapInArrow(add, kind)
    half = made.groupBy("part", F.expr("spark_partition_id() div 64").alias("s")).applyInArrow(total, kind)
    sums = half.groupBy("part").applyInArrow(total, kind).collect()
    table = np.zeros(COUNTERS, np.int64)
    for r in sums:
        table[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.int64)
    return (sums[0]["n"] if sums else 0), table


def rarity(n: int, table: np.ndarray) -> np.ndarray:
    """STEP times the logarithm of the rarity of each counter's shingles, which is log(1 + documents / documents with them)."""
    return (STEP * np.log(np.log1p(n / np.minimum(n, np.maximum(1, table))))).astype(np.float32)


def weights(found: np.ndarray, times: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """(shingles, 2) levels, STEP times logarithms of weights: TF-IDF, which is one more than the logarithm of the frequency,
    times rarity; and the same without rarity."""
    often = STEP * np.log(1 + np.log(times))
    both = np.stack([often + rare[(found % np.uint64(len(rare))).astype(np.int64)], often], 1)
    return np.clip(np.rint(both), LOW, LOW + LEVELS - 1).astype(np.int8)


def weight(level: np.ndarray) -> np.ndarray:
    return np.exp(level / STEP)


@functools.lru_cache(maxsize=1)
def draws() -> np.ndarray:
    """For each level and draw the bits of a, in the upper half of a number, and a number of t in the lower: of r, log c and
    beta as the method has them (Gamma(2, 1), the logarithm of Gamma(2, 1), uniform). Fixed seed: every worker has the same."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    r, log_c, beta = rng.gamma(2.0, 1.0, DRAWS), np.log(rng.gamma(2.0, 1.0, DRAWS)), rng.random(DRAWS)
    out = np.empty((LEVELS, DRAWS), np.uint64)
    for i in range(LEVELS):
        t = np.floor((LOW + i) / STEP / r + beta)
        a = np.exp(log_c - r * (t - beta) - r).astype(np.float32).view(np.uint32).astype(np.uint64)
        out[i] = (a << np.uint64(32)) | (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
    return out.ravel()


def samples(found: np.ndarray, level: np.ndarray, first: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """(texts, n) numbers: for each text that has shingles, n consistent weighted samples.

    For a shingle of weight w, t = floor(log w / r + beta) and log a = log c - r (t - beta) - r; the sample is the shingle
    with the least a, with its t.
    """
    table = draws()
    starts = first[:-1][np.diff(first) > 0]
    low = found & np.uint64(0xFFFFFFFF)
    begin = (level.astype(np.int64) - LOW) * DRAWS
    out = np.empty((len(starts), n), np.uint64)
    for j in range(n):
        at = ((found * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + (j << 1)) % (1 << 64) | 1)) >> np.uint64(28)) & np.uint64(DRAWS - 1)
        out[:, j] = np.minimum.reduceat(table[at.view(np.int64) + begin] ^ low, starts)
    return mix(out & np.uint64(0xFFFFFFFF))


def both_samples(found: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2, n) samples by each of the two weights."""
    return np.stack([samples(found, w[:, k], first) for k in (0, 1)], 1)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of ascending numbers with levels of weights: the least weights over the
    greatest; of the two weightings, the higher."""
    wa, wb = weight(wa), weight(wb)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    least = np.minimum(wa[at[same]], wb[same]).sum(0)
    return float(np.max(least / (wa.sum(0) + wb.sum(0) - least)))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of digests, by the weights with which there are more."""
    return (x == y).reshape(len(x), 2, x.shape[1] // 2).sum(2).max(1)


def sketch(rows: DataFrame, rare) -> DataFrame:
    """(id, fa, fb, digest, bands) of each row (id, text): a 128-bit fingerprint of its weighted set, a byte of each sample, and a
    number for each band, by the one weights and then by the others; all null where a text has no shingle."""
    arrow = [("fa", pa.int64()), ("fb", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                found, times, first = shingles(texts)
                sizes = np.diff(first)
                has = sizes > 0
                n = int(has.sum())
                if n:
                    own = both_samples(found, weights(found, times, rare.value), first)
                    start = first[:-1][has]
                    whole = [np.add.reduceat(mix(found * np.uint64(m) + times.astype(np.uint64)), start).view(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                    digest = (own >> np.uint64(56)).astype(np.uint8).reshape(n, -1)
                    step = np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)
                    bands = mix((own.reshape(n, 2, BANDS, ROWS) * step).sum(3, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).reshape(n, -1)
                where = np.full(len(sizes), -1)
                where[has] = np.arange(n)
                rows = [None if i < 0 else i for i in where]
                arrays = [
                    batch.column(0).slice(at, len(texts)),
                    *[pa.array([None if i is None else whole[k][i] for i in rows], pa.int64()) for k in (0, 1)],
                    pa.array([None if i is None else digest[i].tobytes() for i in rows], pa.binary()),
                    pa.array([None if i is None else bands[i] for i in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *[k for k, _ in arrow]])

    return rows.select("id", "text").mapInArrow(run, "id bigint, fa bigint, fb bigint, digest binary, bands array<bigint>")


def promising(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose digests by either weights agree in ALIKE bytes or more."""
    left = digests.select(F.col("id").alias("a"), F.col("digest").alias("da"))
    right = digests.select(F.col("id").alias("b"), F.col("digest").alias("db"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                good = np.flatnonzero(alike(x, y) >= ALIKE)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "da", "db").mapInArrow(run, "a bigint, b bigint")


def sets_of(ids: DataFrame, rows: DataFrame, rare, scratch: Scratch, name: str) -> DataFrame:
    """(id, k, w): shingles and levels of weights of the rows whose number is among the distinct ``ids``.

    Only those texts are shingled again and moved. Which they are is told by a filter of fixed size, 8 MB, that may let
    some others through; the join with the ids is exact.
    """
    spark, bits = rows.sparkSession, 1 << 26

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(38) for batch in batches]
        if got:
            at = np.unique(np.concatenate(got))
            part = (at >> np.uint64(16)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            data = [x.astype("<u2").tobytes() for x in np.split(at & np.uint64(0xFFFF), cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def unite(group: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, bool)
        for data in group["data"]:
            on[np.frombuffer(data.as_py(), "<u2")] = True
        return pa.table({"part": [group["part"][0].as_py()], "data": [zlib.compress(np.packbits(on).tobytes(), 1)]}, pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    on = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(mark, "part int, data binary").groupBy("part").applyInArrow(unite, "part int, data binary").collect():
        on[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    wanted = spark.sparkContext.broadcast(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(38)).astype(np.int64)
            batch = batch.filter(pa.array((wanted.value[at >> 3] << (at & 7) & 128) > 0))
            for i, texts in blocks(batch.column(1)):
                found, times, first = shingles(texts)
                w = weights(found, times, rare.value)
                keys, ws = found.tobytes(), w.tobytes()
                cut = [(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array([keys[8 * a : 8 * b] for a, b in cut], pa.binary()), pa.array([ws[2 * a : 2 * b] for a, b in cut], pa.binary())], names=["id", "k", "w"])

    sets = rows.select("id", "text").mapInArrow(run, "id bigint, k binary, w binary")
    return scratch.keep(sets.join(ids, "id", "left_semi"), f"{name}-sets")


def verified(pairs: DataFrame, rows: DataFrame, rare, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of those ``pairs`` whose similarity is SIMILARITY or more."""
    ids = scratch.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    sets = sets_of(ids, rows, rare, scratch, name)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"), F.col("w").alias(f"w{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 128):
                for i, x in enumerate(zip(*[c.to_pylist() for c in batch.slice(at, 128).columns[2:]], strict=True)):
                    ka, kb = (np.frombuffer(y, np.uint64) for y in x[:2])
                    wa, wb = (np.frombuffer(y, np.int8).reshape(-1, 2) for y in x[2:])
                    if similarity(ka, wa, kb, wb) >= SIMILARITY - 1e-9:
                        good.append(at + i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in (0, 1)], names=["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return scratch.keep(joined.select("a", "b", "ka", "kb", "wa", "wb").mapInArrow(compare, "a bigint, b bigint"), f"{name}-links")


def similarities(k: np.ndarray, w: np.ndarray, keys: np.ndarray, first: np.ndarray, text: np.ndarray, weights_: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """:func:`similarity` of one text (k, w) to each of many: of these, ``keys`` are their different shingles, ascending,
    ``first`` where the rows of each begin (one more at the end), ``text`` and ``weights_`` whose each row is and with which
    weights, ``whole`` the sums of weights by text."""
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    same = np.flatnonzero(keys[at] == k)
    begin, n, own = first[at[same]], first[at[same] + 1] - first[at[same]], weight(w)
    least = np.zeros((len(whole), 2))
    ends = np.cumsum(n)
    done = 0
    while done < len(same):  # no more than some GATHER rows at once
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + GATHER, "right")))
        size = n[done:to]
        rows = np.repeat(begin[done:to] - np.cumsum(size) + size, size) + np.arange(size.sum())
        for c in (0, 1):
            least[:, c] += np.bincount(text[rows], np.minimum(weights_[rows, c], np.repeat(own[same[done:to], c], size)), len(whole))
        done = to
    return (least / (whole + own.sum(0) - least)).max(1)


def dealt(large: DataFrame, sizes: DataFrame) -> DataFrame:
    """(band, lo, hi, own, id, c): the texts of each bucket of ``large`` (band, id, c) in groups of blocks lo and hi.

    A bucket of up to BLOCK texts and BLOCK_BYTES (``sizes``: id, size) is one group. In a larger one the texts of its most
    frequent component are dealt to blocks of their own, the others to others, and each pair of blocks, but for two of that
    component, is a group: so a large component's texts are copied by what differs from it alone.
    """
    rows = large.join(sizes, "id")
    each = rows.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = lambda c: F.max_by(c, F.struct("n", "c"))
    about = each.groupBy("band").agg(most("c").alias("top"), most("n").alias("tn"), most("size").alias("ts"), F.sum("n").alias("n"), F.sum("size").alias("s"))
    cuts = lambda n, s: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_BYTES))).cast("int")
    n, s, tn, ts = (F.col(c) for c in ("n", "s", "tn", "ts"))
    one = cuts(n, s) == 1
    about = about.select("band", "top", F.when(one, 0).otherwise(cuts(tn, ts)).alias("a"), F.when(one, 1).otherwise(cuts(n - tn, s - ts)).alias("z"))
    top = (F.col("c") == F.col("top")) & (F.col("a") > 0)
    place = lambda cuts: F.pmod(F.xxhash64("id", "band"), cuts).cast("int")
    own = F.when(top, place(F.greatest("a", F.lit(1)))).otherwise(F.col("a") + place(F.col("z")))
    other = F.explode(F.sequence(F.when(top, F.col("a")).otherwise(0), F.col("a") + F.col("z") - 1))
    out = rows.join(about, "band").select("band", "id", "c", own.alias("own"), other.alias("other"))
    return out.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "c")


def across(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between texts that share a bucket of ``large`` and have different components c. Each group that
    :func:`dealt` makes holds each text of one block against all of the other at once, by exact similarity, and gives no more
    than a link for each two components that it joins."""
    group = ["band", "lo", "hi"]
    rows = dealt(large, sets.select("id", (F.length("k") + F.length("w")).alias("size")))
    rows = rows.join(sets, "id").select(*group, "own", "id", "c", "k", "w").repartition(*group).sortWithinPartitions(*group)

    def links(part: pa.RecordBatch) -> tuple[list[int], list[int]]:
        lo, hi = (part.column(i)[0].as_py() for i in (1, 2))
        own, ids, c = (part.column(i).to_numpy() for i in (3, 4, 5))
        set_of = lambda i: (np.frombuffer(part.column(6)[i].as_py(), np.uint64), np.frombuffer(part.column(7)[i].as_py(), np.int8).reshape(-1, 2))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(left) or not len(right):
            return [], []
        if len(left) > len(right):
            left, right = right, left
        sets = [set_of(int(i)) for i in right]
        sizes = [len(k) for k, _ in sets]
        k, w = np.concatenate([k for k, _ in sets]), weight(np.concatenate([w for _, w in sets]))
        text = np.repeat(np.arange(len(right)), sizes)
        whole = np.add.reduceat(w, np.cumsum([0, *sizes[:-1]]))
        order = np.argsort(k, kind="stable")
        k, text, w = k[order], text[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        keys, first = k[first], np.append(first, len(k))
        _, at = np.unique(c, return_inverse=True)
        root = np.arange(at.max() + 1)  # by component, that which it is joined to
        a, b = [], []
        for i in left.tolist():
            if (root[at[right]] == root[at[i]]).all():
                continue
            near = np.flatnonzero(similarities(*set_of(i), keys, first, text, w, whole) >= SIMILARITY - 1e-9)
            while len(near := near[root[at[right[near]]] != root[at[i]]]):
                j = int(right[near[0]])
                root[root == root[at[j]]] = root[at[i]]
                a.append(int(ids[i]))
                b.append(int(ids[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            now = held if batch is None else pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if now is None or not now.num_rows:
                continue
            keys = np.stack([now.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            ends = [*cuts, now.num_rows] if batch is None else cuts
            begin = 0
            for end in ends:
                made = links(now.slice(begin, end - begin).combine_chunks().to_batches()[0])
                if made[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["a", "b"])
                begin = end
            held = now.slice(begin)

    return rows.mapInArrow(run, "a bigint, b bigint")


def linked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the numbers of the stored ``rows`` (id, text) that links reach; component is the least of them.

    In each bucket every text is first held against one other, which bucket and band choose by hash, so that a group of
    any size takes as many pairs as it has texts. What these links leave unconnected within a bucket is then held against
    every other component there: as pairs in buckets of FEW texts or fewer, so that a text has no more than that, and in
    blocks that give only links in larger ones. No pair that shares a bucket is left out but those already connected.
    """
    n, table = counters(rows)
    rare = rows.sparkSession.sparkContext.broadcast(rarity(max(1, n), table))
    named = scratch.keep(sketch(rows, rare), "sketches").where("fa is not null")
    equal = scratch.keep(named.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "equal")
    several = equal.where("n > 1")
    same = scratch.keep(named.select("id", "fa", "fb").join(several, ["fa", "fb"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "same")
    # one row for each text: that of its representative
    texts = scratch.keep(named.join(equal.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "digest", "bands"), "texts")
    scratch.drop("sketches")
    banded = texts.select("id", F.explode(F.array_distinct("bands")).alias("band"))
    order = F.xxhash64("id", "band")
    lead = banded.groupBy("band").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lead = scratch.keep(lead.select("band", "o"), "lead")
    inside = scratch.keep(banded.join(lead, "band").select("band", "id", (order == F.col("o")).alias("leads")), "inside")
    leaders = scratch.keep(inside.where("leads").select("band", F.col("id").alias("b")), "leaders")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = inside.join(leaders, "band").where("id != b").select(*pair(F.col("id"), F.col("b"))).distinct()
    stars = scratch.keep(promising(scratch.keep(stars, "stars"), texts), "star-pairs")
    links = verified(stars, rows, rare, scratch, "stars")
    first = components(links, "near-first")
    placed = inside.select("band", "id").join(first.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    placed = scratch.keep(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    mixed = scratch.keep(mixed.select("band", "m"), "mixed")
    left = scratch.keep(placed.join(mixed, "band").select("band", "id", "c", "m"), "left")
    few = left.where(F.col("m") <= FEW)
    other = few.select("band", F.col("id").alias("id2"), F.col("c").alias("c2"))
    rest = few.join(other, "band").where("c < c2").select(*pair(F.col("id"), F.col("id2"))).distinct().join(stars, ["a", "b"], "left_anti")
    rest = scratch.keep(promising(scratch.keep(rest, "rest"), texts), "rest-pairs")
    more = verified(rest, rows, rare, scratch, "rest")
    large = scratch.keep(left.where(F.col("m") > FEW), "large")
    ids = scratch.keep(large.select("id").distinct(), "large-ids")
    more = more.union(scratch.keep(across(large, sets_of(ids, rows, rare, scratch, "large")), "large-links"))
    scratch.drop("stars-sets", "rest-sets", "large-sets", "texts", "inside", "placed", "left", "large")
    return components(links.union(more).union(same), "near")


def classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, key, class_no, class_id, kept) of the stored ``rows`` (id, key, text): the number and key of the class's first row,
    by key (nulls last) and number, and whether this is that row."""
    found = scratch.keep(linked(rows, scratch).join(rows.select(F.col("id").alias("node"), "key"), "node"), "members")
    best = F.min_by(F.struct("node", "key"), F.struct(F.col("key").isNull(), "key", "node"))
    heads = scratch.keep(found.groupBy("component").agg(best.alias("head")), "heads")
    named = found.join(heads, "component").select(F.col("node").alias("id"), "key", F.col("head.node").alias("class_no"), F.col("head.key").alias("class_id"), (F.col("head.node") == F.col("node")).alias("kept"))
    alone = rows.select("id", "key").join(found.select(F.col("node").alias("id")), "id", "left_anti")
    return named.unionByName(alone.select("id", "key", F.col("id").alias("class_no"), F.col("key").alias("class_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, kept, class_no) of each row: class_id is the least key of those that links reach, kept the first row
    with it, class_no a number that tells classes with equal least keys apart.

    Two rows are linked if their texts' weighted Jaccard similarity is 0.8 or more, with rarity in the weights or without, as
    found by bands (which miss a pair at exactly 0.8 once in some thousand times, and less above). Texts with equal weighted
    sets are one text from the start, and never paired. A row without a shingle (null or blank text) is a class of its own.
    Rows that repeat a key are rows of their own: each is in the class of its own text, and of rows with the least key of a
    class one is kept. A null key comes after all others: class_id is null only where every key of the class is.
    """
    scratch = Scratch(docs.sparkSession, "near")
    own = docs.select(F.monotonically_increasing_id().alias("id"), docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return classes(scratch.keep(own, "rows"), scratch).select(F.col("key").alias("doc_id"), "class_id", "kept", "class_no")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`, as it is, and all its columns."""
    scratch = Scratch(docs.sparkSession, "dedup")
    number = fresh(docs, "id")
    stored = scratch.keep(docs.withColumn(number, F.monotonically_increasing_id()), "docs")
    rows = stored.select(F.col(number).alias("id"), stored[key].cast("long").alias("key"), stored[text].alias("text"))
    gone = scratch.keep(classes(rows, scratch).where("not kept").select(F.col("id").alias(number)), "gone")
    return stored.join(gone, number, "left_anti").select(*[stored[f"`{c}`"] for c in docs.columns])
