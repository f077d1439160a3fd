"""Exact token counts of whole texts, huge ones in overlapping chunks.

A chunk that begins anywhere may tokenise differently near its start, and one that ends anywhere near its end.
Pre-tokens are found from left to right without looking back, so two chunks that both begin a pre-token at the same
character agree from there on, provided the left one could still see the pattern's look-ahead and any special string
that begins before that character. The first such boundary in an overlap is proven, and the counts are spliced there.
Where an overlap has none, it is widened, at last to the whole rest of the text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

COLUMNS = ("n_bytes", "n_tokens", "over_limit")
#: Characters of a chunk and of the overlap of two; texts up to one chunk are encoded at once.
CHUNK, OVERLAP = 32_768, 256
#: Characters of texts that are encoded in one call.
CALL = 400_000


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def boundaries(encoding, base: int) -> dict[int, int]:
    """Character where a pre-token or a special string begins, to the number of tokens before it."""
    out: dict[int, int] = {}
    last: object = ()
    for i, (word, (begin, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            out.setdefault(base + begin, i)
        last = word
    return out


def margin(tok) -> int:
    """Characters before a chunk's end that special strings may still reach into."""
    return 2 + max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)


def count_long(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in chunks; equal to those of the whole text."""
    guard = margin(tok)
    chunk = max(chunk, 4 * guard)
    encode = functools.partial(tok.encode, add_special_tokens=False)
    total, begin, proven = 0, 0, 0  # of the left chunk: where it begins and from where it is right
    end = min(len(text), begin + chunk)
    left = encode(text[begin:end])
    skip = 0  # its tokens before the proven boundary
    while end < len(text):
        wide = max(overlap, 2 * guard)
        marks = boundaries(left, begin)
        while True:
            start = max(proven, end - wide)
            stop = min(len(text), start + chunk + wide)
            right = encode(text[start:stop])
            others = boundaries(right, start)
            # the last pre-tokens of the left chunk may be cut short
            sure = sorted(marks)[:-2]
            common = next((p for p in sure if p > start and proven < p <= end - guard and p in others), None)
            if common is not None:
                total += marks[common] - skip
                begin, proven, end, left, skip = start, common, stop, right, others[common]
                break
            if start == proven:  # nothing between the proven place and the end can be trusted: read on from there
                end = min(len(text), start + 2 * (stop - start))
                begin, left, skip = start, encode(text[start:end]), 0
                break
            wide *= 4
    return total + len(left.ids) - skip


def count_all(texts: list[str], tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    counts = [0] * len(texts)
    waiting: list[int] = []
    size = 0

    def flush() -> None:
        for i, e in zip(waiting, tok.encode_batch_fast([texts[i] for i in waiting], add_special_tokens=False), strict=True):
            counts[i] = len(e)
        waiting.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk:
            counts[i] = count_long(text, tok, chunk, overlap)
        elif text:
            if size + len(text) > CALL:
                flush()
                size = 0
            waiting.append(i)
            size += len(text)
    flush()
    return counts


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` (its columns ``keep`` only, if given) with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    A null text counts as empty. Tokens are those of the library for the file at ``path``, without added special tokens.
    Columns of ``df`` with names of added ones are replaced. No shuffle; each row by itself.
    """
    lean(df.sparkSession)
    names = [c for c in (keep or df.columns) if c.lower() not in COLUMNS]
    rows = df.select(*[df[f"`{c}`"] for c in names], F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(df[text], F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            counts: list[int] = []
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, len(texts), 256):
                counts += count_all(texts.slice(at, 256).to_pylist(), tok)
            arrays = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
