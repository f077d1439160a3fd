"""Words of many texts at once, as numbers: byte operations over a whole Arrow array, no Python object per word.

A word is a run of bytes other than space and 9 to 13. Its number is a 64-bit hash of its bytes with A-Z in lower case,
the same wherever it stands: a polynomial modulo 2^64, taken as a difference of running sums, then mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, but for longer single texts.
BLOCK = 1_000_000
_ODD = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    loose = space.copy()  # all ASCII that is neither letter nor digit
    for b in range(128):
        if not chr(b).isalnum():
            loose[b] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    return space, loose, lower + np.uint64(1)


SPACE, LOOSE, LOWER = _tables()


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(_ODD)
    back = np.uint64(pow(_ODD, -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, back)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    h = (h ^ (h >> np.uint64(32))) * _BACK
    h = (h ^ (h >> np.uint64(32))) * _BACK
    return h ^ (h >> np.uint64(32))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) such that a slice has at most ``size`` bytes or is one text."""
    if not len(texts):
        return
    _, offs = raw(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def find(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): where each word lies, and by text the index of its first word, with the number of words last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = between[data]
    new = np.zeros(n + 1, bool)
    new[offs] = True
    start = ~gap
    start[1:] &= gap[:-1] | new[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | new[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def fold(data: np.ndarray) -> np.ndarray:
    """Byte values for hashing: A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[capital] += np.uint64(0x20)
    return out


def hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each stretch ``s`` to ``e`` of ``values``."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def words(texts: pa.Array, between: np.ndarray = SPACE, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, first): of the words of all texts, and by text where its words begin (one more at the end)."""
    data, offs = raw(texts)
    s, e, first = find(data, offs, between)
    return hashes(fold(data) if folded else LOWER[data], s, e), first


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(64)]


def runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of each run of ``n`` words within a text. A text with fewer has one run, of all its words; one with
    none has none."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    full = np.zeros(0, np.uint64)
    if len(h) >= n:
        full = h[: len(h) - n + 1] * _STEP[0]
        for k in range(1, n):
            full = full + h[k : len(h) - n + 1 + k] * _STEP[k]
        whole = text[: len(full)] == text[n - 1 :]
        full, at = full[whole], text[: len(full)][whole]
    else:
        at = np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        short = np.array([int(np.sum(h[first[i] : first[i + 1]] * np.array(_STEP[: counts[i]], np.uint64), dtype=np.uint64)) for i in few], np.uint64)
        full, at = np.concatenate([full, short]), np.concatenate([at, few])
    return mix(full), at
