"""Language-model scoring with a log-frequency Bloom filter.

Counts of pairs of neighbours are quantised by their logarithm. A pair whose count has level q is put into a Bloom filter q
times, as (pair, 1) .. (pair, q), and probing (pair, 1), (pair, 2), .. until one is missing gives the level back. The first
level has as many probes as the vocabulary asks for, so that what unseen pairs get by error stays within ERROR of what every
word has together. Words have exact counts, and each word the sum of the quantised counts of the pairs that it begins, read
back through the filter: by that sum pair probabilities are normalised, smoothed by the word's own (Dirichlet).

The filter is made in parts by leading bits of the key, each in one task. Filter, counts and sums are broadcast while they
are below a bound; beyond it the keys that texts ask for go to the parts, and answers come back. Scores are the same.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, release
from .words import blocks, mix, unmix, words

#: The number of the token that ends each text, and stands before its first.
END = np.uint64(0x5851F42D4C957F2D)
#: Base of the quantised logarithm; bits of the filter for each (pair, level) above the first; probes of each.
BASE, BITS, PROBES = 1.5, 12, 8
#: What unseen pairs get by error after any word, as a share of LEAST words, which is the least prior.
ERROR, LEAST = 0.01, 10.0
#: Bytes of filter, counts and sums that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text for each part of the filter, or fewer; bits of the least number of parts; keys that a part is asked at once.
PART, LEAD, AT_ONCE = 32 << 20, 6, 1 << 16
#: Bytes of texts, or one text, that ask a filter together that isn't broadcast.
CHUNK = 4 << 20
#: Turns in which askers meet the parts of the filter: what is shuffled at once is so much less.
TURNS = 2
#: Priors that are tried, in words.
PRIORS = tuple(LEAST * 2**k for k in range(13))
#: Tokens that a task gathers before it counts them.
GATHER = 1_500_000
ADD = 0.1
_HIGH, _HALF = np.uint64(0xFFFFFFFF00000000), np.uint64(32)
WORDS, PAIRS = 0, 1
ZSTD = {"spark.sql.parquet.compression.codec": "zstd"}
SUMS, FILTER = 1, 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each token, first): the words of each text and one end."""
    h, first = words(texts)
    out = np.full(len(h) + len(first) - 1, END)
    ends = first[1:] + np.arange(len(first) - 1)
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest] = h
    return out, np.concatenate([[0], ends + 1]).astype(np.int64)


def pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number for two words: half of each one's, scrambled. The first half can be had back."""
    return mix((before & _HIGH) | (after >> _HALF))


def pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each token with the one before it."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = END
    return pair(before, h)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts, new) if len(keys) else counts
    return keys[new], sums.astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of the whole numbers that have it; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (level + 0.0) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def _slots(keys: np.ndarray, level: int, bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    h = mix(keys + np.uint64(level * 0xA0761D6478BD642F % (1 << 64)))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    for i in range(probes):
        yield (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)


def sure_probes(vocabulary: int) -> int:
    """Probes of the first level, by which one pair in 2^probes is taken for seen: few enough over a whole vocabulary."""
    return max(PROBES, math.ceil(math.log2(max(1, vocabulary) / (ERROR * LEAST))))


def segment(keys: np.ndarray, q: np.ndarray, sure: int) -> tuple[int, int, bytes]:
    """(bits of the first level, bits of the others, filter) of one part's pairs and their levels."""
    sizes = [max(64, math.ceil(n)) + 7 & ~7 for n in (len(keys) * sure * 1.4427, int((q - 1).sum()) * BITS)]
    if max(sizes) >= 1 << 32:
        raise ValueError("a part of the filter is too large: more parts are needed")
    on = [np.zeros(n, bool) for n in sizes]
    for level in range(1, int(q.max(initial=0)) + 1):
        for slot in _slots(keys[q >= level], level, np.uint64(sizes[level > 1]), sure if level == 1 else PROBES):
            on[level > 1][slot] = True
    return *sizes, b"".join(np.packbits(x, bitorder="little").tobytes() for x in on)


class LogFilter:
    """Segments in the order of their parts; a part has the keys with the same leading ``lead`` bits."""

    def __init__(self, lead: int, sizes: np.ndarray, data: np.ndarray, sure: int):
        self.lead, self.data, self.sure = lead, data, sure
        self.bits = np.asarray(sizes, np.uint64).reshape(-1, 2)
        self.begin = (np.cumsum(self.bits.ravel()) - self.bits.ravel()).reshape(-1, 2).astype(np.uint64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 for none, by probes until one fails."""
        part = (keys >> np.uint64(64 - self.lead)).astype(np.int64) if self.lead else np.zeros(len(keys), np.int64)
        out = np.zeros(len(keys), np.int64)
        left, n = np.arange(len(keys)), 0
        while len(left):
            n += 1
            kind = int(n > 1)
            bits, begin = self.bits[part[left], kind], self.begin[part[left], kind]
            alive = np.arange(len(left))
            for slot in _slots(keys[left], n, bits, PROBES if kind else self.sure):
                at = begin[alive] + slot[alive]
                alive = alive[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
                if not len(alive):
                    break
            left = left[alive]
            out[left] = n
        return out


def cut(keys: np.ndarray, lead: int, width: int = 64) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the parts that ascending ``keys`` have."""
    if not len(keys):
        return
    part = (keys >> np.array(width - lead, keys.dtype)).astype(np.int64) if lead else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(part[begin].tolist(), begin.tolist(), np.append(begin[1:], len(keys)).tolist(), strict=True)


def count(df: DataFrame, text: str, lead: int) -> DataFrame:
    """A row for each part: words and their counts, pairs and their levels, as bytes of arrays in ascending order of keys."""
    rows = df.select(df[text].alias("text"))
    arrow = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("once", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def deal(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        size = 0
        for part, a, b in cut(keys, lead):
            one = counts[a:b] == 1
            made.append({"part": part, "kind": kind, "once": keys[a:b][one].tobytes(), "keys": keys[a:b][~one].tobytes(), "counts": counts[a:b][~one].astype(np.uint32).tobytes()})
            size += b - a
            if size > 250_000:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                h, first = tokens(texts)
                held.append((h, pairs(h, first)))
                n += len(h)
                if n >= GATHER:
                    for kind in (WORDS, PAIRS):
                        yield from deal(kind, *tally(np.concatenate([x[kind] for x in held])))
                    held, n = [], 0
                    release()
        for kind in (WORDS, PAIRS) if held else ():
            yield from deal(kind, *tally(np.concatenate([x[kind] for x in held])))
        release()

    def merge(group: pa.Table) -> pa.Table:
        both = []
        for kind in (WORDS, PAIRS):
            own = group.filter(pa.compute.equal(group["kind"], kind))
            once = [np.frombuffer(x.as_py(), np.uint64) for x in own["once"]]
            more = [np.frombuffer(x.as_py(), np.uint64) for x in own["keys"]]
            counts = [np.ones(sum(map(len, once)), np.int64), *(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in own["counts"])]
            both.append(tally(np.concatenate([np.zeros(0, np.uint64), *once, *more]), np.concatenate(counts)))
        (words_, times), (pairs_, often) = both
        q = levels(often).astype(np.uint8) if len(often) else np.zeros(0, np.uint8)
        end = np.flatnonzero(words_ == END)
        out = {"part": group["part"][0].as_py(), "n": int(times.sum()), "v": len(times), "texts": int(times[end].sum()), "words": words_.tobytes(), "times": times.tobytes(), "pairs": pairs_.tobytes(), "levels": q.tobytes()}
        made = pa.table({k: [v] for k, v in out.items()}, pa.schema([("part", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("texts", pa.int64()), *((k, pa.binary()) for k in ("words", "times", "pairs", "levels"))]))
        release()
        return made

    parts = rows.mapInArrow(gather, "part int, kind int, once binary, keys binary, counts binary")
    return parts.groupBy("part").applyInArrow(merge, "part int, n bigint, v bigint, texts bigint, words binary, times binary, pairs binary, levels binary")


def build_filter(counted: DataFrame, sure: int) -> DataFrame:
    """(part, first, others, data, heads, sums): a filter segment of each part with all its pairs; and for the first words of
    these pairs, as half numbers, the sum of their counts as the segment gives them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                two, q = np.frombuffer(batch.column(1)[i].as_py(), np.uint64), np.frombuffer(batch.column(2)[i].as_py(), np.uint8).astype(np.int64)
                first, others, data = segment(two, q, sure)
                back = level_count(LogFilter(0, np.array([first, others]), np.frombuffer(data, np.uint8), sure).level(two))
                heads = (unmix(two) >> _HALF).astype(np.uint32)
                order = np.argsort(heads, kind="stable")
                at = np.flatnonzero(np.diff(heads[order].astype(np.int64), prepend=-1))
                sums = np.add.reduceat(back[order], at) if len(at) else back
                row = [[batch.column(0)[i].as_py()], [first], [others], [data], [heads[order][at].tobytes()], [sums.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "first", "others", "data", "heads", "sums"])
        release()

    return counted.select("part", "pairs", "levels").mapInArrow(run, "part int, first bigint, others bigint, data binary, heads binary, sums binary")


def totals(segments: DataFrame, lead: int) -> DataFrame:
    """(part, heads, sums): the sums of :func:`build_filter` over all parts, in parts by leading bits of the first word."""
    arrow = pa.schema([("part", pa.int32()), ("heads", pa.binary()), ("sums", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heads, sums = np.frombuffer(batch.column(0)[i].as_py(), np.uint32), np.frombuffer(batch.column(1)[i].as_py(), np.float64)
                made = [{"part": part, "heads": heads[a:b].tobytes(), "sums": sums[a:b].tobytes()} for part, a, b in cut(heads, lead, 32)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, arrow)

    def add(group: pa.Table) -> pa.Table:
        heads = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["heads"]])
        sums = np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in group["sums"]])
        order = np.lexsort((sums, heads))  # one order of adding, whatever the order of arrival
        at = np.flatnonzero(np.diff(heads[order].astype(np.int64), prepend=-1))
        return pa.table({"part": [group["part"][0].as_py()], "heads": [heads[order][at].tobytes()], "sums": [np.add.reduceat(sums[order], at).tobytes()]}, arrow)

    return segments.select("heads", "sums").mapInArrow(deal, "part int, heads binary, sums binary").groupBy("part").applyInArrow(add, "part int, heads binary, sums binary")


class Look:
    """Counts of words, sums of what follows them, and levels of pairs."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, heads: np.ndarray, sums: np.ndarray, level: Callable[[np.ndarray], np.ndarray]):
        self.keys, self.times, self.heads, self.sums, self.level = keys, times, heads, sums, level

    def counts(self, own: np.ndarray) -> np.ndarray:
        return find(self.keys, self.times, own).astype(np.int64)

    def following(self, own: np.ndarray) -> np.ndarray:
        return find(self.heads, self.sums, (own >> _HALF).astype(np.uint32))


def find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, 0 where it isn't among the ascending ``keys``."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def looked_up(look: Look, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(first, count, seen, sum) by token, and where each text begins: the token's count, how often the pair with the one
    before was seen, by the filter, and what the one before is followed by in all."""
    h, first = tokens(texts)
    own, where = np.unique(h, return_inverse=True)
    c = look.counts(own)
    place = np.empty(len(h), np.int64)
    place[1:] = where[:-1]
    place[first[:-1]] = np.searchsorted(own, END)
    known = np.flatnonzero((c[where] > 0) & (c[place] > 0))
    keys, back = np.unique(pair(own[place[known]], h[known]), return_inverse=True)
    seen = np.zeros(len(h))
    seen[known] = level_count(look.level(keys))[back]
    return first, c[where], seen, look.following(own)[place]


class Model:
    """What scoring needs: totals, tables in parts, the prior; and all in one broadcast where that is small enough.

    The prior is found when it is first asked for, by a pass over all training texts, or by :func:`score` in its own.
    """

    def __init__(self, train: DataFrame, text: str = "text"):
        spark = self.spark = train.sparkSession
        scratch = Scratch(spark, "lm")
        size = train.agg(F.coalesce(F.sum(F.octet_length(train[text])), F.lit(0)).alias("n")).first()["n"]
        # by size; where there is little text, so many that all cores have some
        self.size = size
        self.lead = max(LEAD, (2 * spark.sparkContext.defaultParallelism - 1).bit_length(), (size // PART).bit_length())
        self.counted = scratch.keep(count(train, text, self.lead), "counted")
        about = self.counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "texts")]).first()
        self.n, self.v = about["n"], about["v"]
        self.under = self.n + ADD * (self.v + 1)
        self.sure = sure_probes(self.v)
        self.segments = scratch.keep(build_filter(self.counted, self.sure), "filter")
        self.totals = scratch.keep(totals(self.segments, self.lead), "totals")
        # pairs are in the filter now: of the counts only words are asked for
        self.counted = scratch.keep(self.counted.select("part", "words", "times"), "words")
        scratch.drop("counted")
        bytes_ = self.segments.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first()["n"] + 28 * self.v
        self.sent = spark.sparkContext.broadcast(self.gathered()) if bytes_ <= BROADCAST_BYTES else None
        self.texts, self.train, self.fitted = about["texts"], train.select(train[text].alias("t")), None

    @property
    def prior(self) -> float:
        """That of PRIORS under which the training texts are likeliest, each token left out of the counts."""
        if self.fitted is None:
            names = [f"p{i}" for i in range(len(PRIORS))]
            likely = evaluate(self.train, self, trials(self.under), names) if self.texts else None
            self.fit(likely.agg(*[F.sum(c) for c in names]).first() if self.texts else ())
        return self.fitted

    def fit(self, likely: Sequence[float | None]) -> int:
        """Takes the prior of the highest log probability; its place among PRIORS."""
        best = int(np.argmax([x if x is not None else -math.inf for x in likely])) if self.texts else 0
        self.fitted = PRIORS[best]
        return best

    def gathered(self) -> tuple:
        """Everything as arrays in the order of keys."""
        rows = sorted((r["part"], r["first"], r["others"]) for r in self.segments.select("part", "first", "others").collect())
        none = segment(np.zeros(0, np.uint64), np.zeros(0, np.int64), self.sure)[:2]
        have = {p: (a, b) for p, a, b in rows}
        sizes = np.array([have.get(p, none) for p in range(1 << self.lead)], np.int64)
        ends = np.cumsum(sizes.sum(1)) // 8
        data = np.zeros(int(ends[-1]), np.uint8)
        for r in self.segments.select("part", "data").toLocalIterator():
            data[ends[r["part"]] - len(r["data"]) : ends[r["part"]]] = np.frombuffer(r["data"], np.uint8)

        def table(df: DataFrame, a: str, b: str, kinds: tuple) -> tuple[np.ndarray, np.ndarray]:
            rows = sorted(((r["part"], np.frombuffer(r[a], kinds[0]), np.frombuffer(r[b], kinds[1])) for r in df.select("part", a, b).toLocalIterator()), key=lambda r: r[0])
            return tuple(np.concatenate([np.zeros(0, kinds[i]), *(r[1 + i] for r in rows)]) for i in (0, 1))

        return self.lead, sizes, data, self.sure, *table(self.counted, "words", "times", (np.uint64, np.int64)), *table(self.totals, "heads", "sums", (np.uint32, np.float64))


def look_of(sent: tuple) -> Look:
    lead, sizes, data, sure, *tables = sent
    return Look(*tables, LogFilter(lead, sizes, data, sure).level)


def trials(under: float) -> Callable[[Look, pa.Array], list[np.ndarray]]:
    """For each of PRIORS, the log10 probability of each text, every token left out of all counts when it is its turn."""
    return lambda look, texts: left_out(under, *looked_up(look, texts))


def left_out(under: float, first: np.ndarray, c: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    p, rest, all_ = (np.maximum(c - 1, 0) + ADD) / under, np.maximum(seen - 1, 0), np.maximum(sums - 1, 0)
    return [np.add.reduceat(np.log10((rest + prior * p) / (all_ + prior)), first[:-1]) for prior in PRIORS]


def scores(n: int, under: float, priors: Sequence[float], fit: bool = False) -> Callable[[Look, pa.Array], list[np.ndarray]]:
    """The columns of :func:`score`, its last for each of ``priors``; and for ``fit`` those of :func:`trials`."""

    def run(look: Look, texts: pa.Array) -> list[np.ndarray]:
        first, c, seen, sums = found = looked_up(look, texts)
        p, sizes = (c + ADD) / under, np.diff(first)
        by_text = lambda x: np.add.reduceat(x, first[:-1])
        own = [sizes, by_text((c > 0).astype(np.int64)), np.full(len(sizes), n), by_text(np.log10(p)), *[by_text(np.log10((seen + prior * p) / (sums + prior))) for prior in priors]]
        return own + (left_out(under, *found) if fit else [])

    return run


def packed(rows: DataFrame) -> DataFrame:
    """(data): texts that ask together, with the other columns of ``rows`` (.., t), as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in held:
                    stream.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

        for batch in batches:
            at = 0
            for i, n in enumerate(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_pylist()):
                if size and size + n > CHUNK:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield made()
                    held, size, at = [], 0, i
                size += n
            if batch.num_rows > at:
                held.append(batch.slice(at))
        if held:
            yield made()
        release()

    return rows.mapInArrow(run, "data binary")


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    made = table[name].combine_chunks()
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


def asked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, with the end, and distinct pairs of the texts, ascending, and so by parts."""
    own, two = [np.array([END])], [np.zeros(0, np.uint64)]
    for _, some in blocks(texts):
        h, first = tokens(some)
        own.append(h)
        two.append(pairs(h, first))
    return tally(np.concatenate(own))[0], tally(np.concatenate(two))[0]


def answers(stored: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(c, part, kind, a, b): for each chunk of texts, counts (a) and sums (b) of the words that it asks for, and levels (a) of
    its pairs, in parts by leading bits of the key. A part's tables are read where its askers meet; nothing is broadcast
    and no key is left out. Texts are not shuffled for that, and parts have their TURNS."""
    lead, sure = model.lead, model.sure
    arrow = pa.schema([("c", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())])
    given = pa.schema([("c", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def ask(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    both = asked(column(unpacked(data.as_buffer()), "t"))
                    made = [{"c": chunk, "part": part, "kind": kind, "keys": keys[a:b].tobytes()} for kind, keys in zip((WORDS, FILTER), both, strict=True) for part, a, b in cut(keys, lead) if part % TURNS == turn]
                    if made:
                        yield pa.RecordBatch.from_pylist(made, arrow)
                    release()

        return run

    def reply(some: pa.Table, tables: pa.Table) -> pa.Table:
        have = {r["kind"]: r for r in tables.to_pylist()}
        of = lambda kind, c, as_: np.frombuffer(have[kind][c], as_) if kind in have else np.zeros(0, as_)
        level = LogFilter(0, np.array([have[FILTER]["first"], have[FILTER]["others"]]), of(FILTER, "x", np.uint8), sure).level if FILTER in have else lambda k: np.zeros(len(k), np.int64)
        look = Look(of(WORDS, "x", np.uint64), of(WORDS, "y", np.int64), of(SUMS, "x", np.uint32), of(SUMS, "y", np.float64), level)
        made = []
        for kind in (WORDS, FILTER):  # the keys of all chunks together
            own = some.filter(pa.compute.equal(some["kind"], kind))
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in own["keys"]]
            if not keys:
                continue
            at, all_ = np.cumsum([len(k) for k in keys])[:-1], np.concatenate(keys)
            del keys
            if kind == WORDS:
                a, b = (np.split(x, at) for x in (look.counts(all_), look.following(all_)))
            else:
                q = [look.level(all_[i : i + AT_ONCE]).astype(np.uint8) for i in range(0, len(all_), AT_ONCE)]
                a = np.split(np.concatenate(q), at)
                b = [np.zeros(0)] * len(a)
            kinds = [own["c"], own["part"], own["kind"], pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())]
            made.append(pa.table(kinds, given))
        release()
        return pa.concat_tables(made) if made else given.empty_table()

    none = F.lit(0).cast("long")
    tables = model.counted.select("part", F.lit(WORDS).alias("kind"), F.col("words").alias("x"), F.col("times").alias("y"), none.alias("first"), none.alias("others"))
    tables = tables.unionByName(model.totals.select("part", F.lit(SUMS).alias("kind"), F.col("heads").alias("x"), F.col("sums").alias("y"), none.alias("first"), none.alias("others")))
    tables = tables.unionByName(model.segments.select("part", F.lit(FILTER).alias("kind"), F.col("data").alias("x"), F.lit(b"").alias("y"), "first", "others"))

    def turn(k: int) -> DataFrame:
        asks = stored.select("c", "data").mapInArrow(ask(k), "c bigint, part int, kind int, keys binary")
        met = asks.groupBy("part").cogroup(tables.where(F.col("part") % TURNS == k).groupBy("part")).applyInArrow(reply, "c bigint, part int, kind int, a binary, b binary")
        return scratch.keep(met, f"answers{k}", ZSTD)

    return functools.reduce(DataFrame.unionByName, [turn(k) for k in range(TURNS)])


def evaluate(rows: DataFrame, model: Model, figures: Callable[[Look, pa.Array], list[np.ndarray]], names: list[str], whole: int = 0) -> DataFrame:
    """``rows`` (.., t) with what ``figures`` says of each text t, as columns ``names``, the first ``whole`` of them integers."""
    kept, sent = [c for c in rows.columns if c != "t"], model.sent
    kinds = [pa.int64() if i < whole else pa.float64() for i in range(len(names))]
    schema = rows.drop("t").schema
    for i, c in enumerate(names):
        schema = schema.add(c, "long" if i < whole else "double")

    def columns(look: Look, column: pa.Array) -> list[pa.Array]:
        found = [figures(look, texts) for _, texts in blocks(column)]
        return [pa.array(np.concatenate([f[i] for f in found]) if found else [], kind) for i, kind in enumerate(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = look_of(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns(look, batch.column(batch.num_columns - 1))], names=[f.name for f in schema])
            release()

    def meet(group: pa.Table, given: pa.Table) -> pa.Table:
        own_rows = unpacked(group["data"][0].as_buffer())
        texts = column(own_rows, "t")
        own, two = asked(texts)
        given = given.sort_by("part")
        got = lambda kind, c, as_: np.frombuffer(b"".join(x for x, k in zip(given[c].to_pylist(), given["kind"].to_pylist(), strict=True) if k == kind), as_)
        q, heads = got(FILTER, "a", np.uint8), own >> _HALF
        once = np.flatnonzero(np.diff(heads.astype(np.int64), prepend=-1))
        look = Look(own, got(WORDS, "a", np.int64), heads[once].astype(np.uint32), got(WORDS, "b", np.float64)[once], lambda keys: q[np.searchsorted(two, keys)].astype(np.int64))
        made = pa.table([*[own_rows[c] for c in kept], *columns(look, texts)], names=[f.name for f in schema])
        release()
        return made

    if sent is not None:
        return rows.select(*kept, "t").mapInArrow(run, schema)
    scratch = Scratch(rows.sparkSession, "score")
    # the chunk's number must be the same in all uses
    few = rows.select(*kept, "t").coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, model.size // CHUNK))  # full chunks
    stored = scratch.keep(packed(few).withColumn("c", F.monotonically_increasing_id()).select("c", "data"), "rows")
    return stored.groupBy("c").cogroup(answers(stored, model, scratch).groupBy("c")).applyInArrow(meet, schema)


def score(df: DataFrame, model: Model, text: str = "text", prior: float | None = None, keep: tuple[str, ...] = ("doc_id",), trained: Column | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` with n_tokens, n_known, train_tokens, base_score and score.

    A null text counts as empty: one token, the end. base_score: the sum of log10 of p = (c + 0.1) / (N + 0.1 (V + 1)), with
    exact counts. score: log10 of the text's probability, each token given the one before: (seen + prior p) / (sum of seen
    after the word before + prior), seen by the filter, for words that were learned. After any word these add up to 1 over
    the vocabulary and one unknown word, and to 1 + ERROR at most with the filter's errors. The prior, if not given, is that
    under which all training texts are likeliest, each token left out of the counts; where ``trained`` says which rows of
    ``df`` are these texts, it is found in the same pass, by scores for each. Rows by themselves where
    the model is broadcast; else texts by chunks meet the answers to their keys. Columns of ``keep`` with names of added
    ones are left out; rows that repeat a key are texts of their own.
    """
    names = [c for c in keep if c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    rows = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(names)], df[text].alias("t"))
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if prior is None and trained is not None and model.fitted is None:
        each, likely = [[f"{c}{i}" for i in range(len(PRIORS))] for c in "sp"]
        flagged = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(names)], trained.alias("own"), df[text].alias("t"))
        found = evaluate(flagged, model, scores(model.n, model.under, PRIORS, True), [*added[:-1], *each, *likely], 3)
        found = Scratch(df.sparkSession, "fit").keep(found, "scores", ZSTD)
        best = model.fit(found.where("own").agg(*[F.sum(c) for c in likely]).first())
        return found.select(*[f"k{i}" for i in range(len(names))], *added[:-1], each[best]).toDF(*names, *added)
    return evaluate(rows, model, scores(model.n, model.under, [model.prior if prior is None else prior]), added, 3).toDF(*names, *added)


def learned(key: Column) -> Column:
    """Whether a document with this key is learned from: crc32 of the key as text is no multiple of 10; so is a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 10 != 0, F.lit(True))
