"""Token ids of whole documents, packed into rows of equal length.

Documents are cut losslessly into pieces of at most ``length`` tokens. Pieces of a bounded window of consecutive
documents are packed best-fit-decreasing: by descending length, each goes to the row whose remaining room is the
smallest that holds it. A segment tree over room finds that row in logarithmic time.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, release
from .words import blocks

#: Tokens of a row, and tokens of a window after which it is packed.
LENGTH, WINDOW = 2048, 2_000_000
PAD = 0
#: The pre-token pattern of the byte-level vocabularies; fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "shard int, win int, row int, n_tokens int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


class RoomTree:
    """How many open rows have each room from 0 to ``size``, with the smallest sufficient room found in log time."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, (size + 1 - 1).bit_length() + ((size & (size - 1)) == 0))
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``least``, taken out; None if there is none."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of indices of ``lengths``, each 0..``size``; deterministic, ties by index."""
    tree, rows = RoomTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


@functools.lru_cache(maxsize=1)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, enc) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=())


def pack_window(docs: list[tuple[int | None, np.ndarray]], length: int, dtype) -> Iterator[dict]:
    pieces = [(key, n, ids[at : at + length]) for key, ids in docs for n, at in enumerate(range(0, max(1, len(ids)), length))]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        own = [pieces[i] for i in row]
        lengths = np.array([len(p[2]) for p in own])
        ids, at = np.full(length, PAD, dtype), np.zeros(length, dtype)
        used = int(lengths.sum())
        ends = np.cumsum(lengths)
        if used:
            ids[:used] = np.concatenate([p[2] for p in own])
            at[:used] = np.arange(used) - np.repeat(ends - lengths, lengths)
        yield {"n_tokens": used, "doc_ids": [p[0] for p in own], "pieces": [p[1] for p in own], "cu_seqlens": [0, *ends.tolist()], "ids": ids.tobytes(), "position_ids": at.tobytes()}


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, window: int = WINDOW, order: tuple[str, ...] | None = None) -> DataFrame:
    """Packed rows of all documents of ``df``, by the byte-level vocabulary of ranks at ``path``.

    Documents are range-sorted by ``order`` (the key, if not given; ties as they are stored), so windows hold neighbours of
    that order however the input's files are split. shard: the range's place in the order; win: the window's place in the
    shard; row: the row's in the window. n_tokens: of the row; the rest is padding (0). doc_ids, pieces: of each segment, its
    document and which piece of it this is, from 0. cu_seqlens: 0 and the end of each segment. ids, position_ids:
    ``length`` little-endian unsigned numbers of 2 bytes (4 if the vocabulary or ``length`` is larger), positions beginning
    at 0 with each segment. A document without tokens (null or empty text) is a segment of length 0. Rows that repeat a key
    are documents of their own, and so are rows with a null key. Special strings are ordinary text. Memory holds one window
    of token ids.
    """
    lean(df.sparkSession)
    own = df.select(df[key].cast("long").alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), *[df[f"`{c}`"].alias(f"o{i}") for i, c in enumerate(order or (key,))], F.monotonically_increasing_id().alias("n"))
    by = [*[f"o{i}" for i in range(len(order or (key,)))], "n"]
    rows = own.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "text")
    arrow = pa.schema(
        [("shard", pa.int32()), ("win", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        dtype = np.dtype("<u2" if max(enc.n_vocab, length) <= 65_536 else "<u4")
        shard, win = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            made: list[dict] = []
            for n, row in enumerate(pack_window(held, length, dtype)):
                made.append({"shard": shard, "win": win, "row": n} | row)
                if len(made) == 500:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)

        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                part = batch.slice(at, len(texts))
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(t, enc).astype(dtype) if t else np.zeros(0, dtype)
                    held.append((k, ids))
                    tokens += len(ids) + 1
                    if tokens >= window:
                        yield from flush()
                        held, tokens, win = [], 0, win + 1
                        release()
        if held:
            yield from flush()
        release()

    return rows.mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, path: str) -> DataFrame:
    """(key, text) of the documents in ``packed``: the inverse of :func:`pack`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "piece": [], "ids": []}
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2" if encoding(path).n_vocab <= 65_536 else "<u4")
                for k, n, a, b in zip(row["doc_ids"], row["pieces"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
                    out["key"].append(k)
                    out["piece"].append(n)
                    out["ids"].append(b"".join(encoding(path).decode_tokens_bytes(ids[a:b].tolist())))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())]))

    parts = packed.mapInArrow(run, "key bigint, piece int, ids binary")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    return parts.groupBy("key").agg(F.decode(F.unhex(joined), "UTF-8").alias("text"))
