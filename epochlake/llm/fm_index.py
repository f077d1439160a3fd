"""A compressed full-text index of symbols: backward search over a wavelet tree, for many streams at once.

The Burrows-Wheeler transform is of suffixes sorted by their first ``depth`` symbols, which is all that patterns of up to that
length need. It is stored as a wavelet matrix (a wavelet tree without pointers): one vector of bits a level, with counts for
each 64 of them.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A vector of bits that counts those before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        self.words = np.packbits(np.pad(bits.astype(bool), (0, 64 * n - len(bits))), bitorder="little").view(np.uint64)
        self.before = np.zeros(n, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits before ``at`` are set."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Symbols 0 to ``size`` - 1 of a sequence, with the number of each before any place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, (size - 1).bit_length()))):
            bit = (symbols >> shift) & 1
            zeros = symbols[bit == 0]
            self.levels.append((shift, Bits(bit), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bit == 1]])
        every = np.arange(size)
        self.first = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.first[symbol]


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next ``depth`` symbols; beyond the end stands 0. By ranks of doubled length."""
    n = len(text)
    rank, have = text.astype(np.int64), 1
    order = np.arange(n)
    while True:
        top = int(rank.max(initial=0)) + 1
        key, reach = rank, have
        while reach < depth and top * (int(key.max(initial=0)) + 1) < 1 << 62:  # as many stretches as a number holds
            shift = min(reach, depth - have)
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - shift)] = rank[shift:]
            if shift < reach:  # the last stretch overlaps, and then all symbols are in
                key, reach = key * top + ahead, shift + have
                break
            key, reach = key * top + ahead, reach + have
        order = np.argsort(key)
        if reach >= depth:
            return order
        new = np.ones(n, np.int64)
        new[0] = 0
        own = key[order]
        new[1:] = own[1:] != own[:-1]
        rank, have = np.empty(n, np.int64), reach
        rank[order] = np.cumsum(new)


class FMIndex:
    """Index of ``text``, symbols from 0 on, of which 0 separates pieces: no pattern holds it. Patterns have up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        size = int(text.max(initial=0)) + 1
        self.places = sort_suffixes(text, depth)
        self.tree = WaveletTree(text[self.places - 1], size)
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        padded, same = np.r_[text, np.zeros(depth, text.dtype)], np.ones(max(0, self.n - 1), bool)
        self.common = np.zeros(self.n + 1, np.int8)  # symbols that a suffix has in common with the one before it
        for k in range(depth):
            same &= padded[self.places[1:] + k] == padded[self.places[:-1] + k]
            self.common[1:-1] += same
        self._groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def groups(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each suffix's group, where groups begin, with the end last) of suffixes that begin with the same ``length``
        symbols."""
        if length not in self._groups:
            new = self.common[:-1] < length
            new[:1] = True
            self._groups[length] = np.cumsum(new) - 1, np.r_[np.flatnonzero(new), self.n]
        return self._groups[length]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: ranges of suffixes for patterns with ``symbol`` put before them."""
        both = self.smaller[np.r_[symbol, symbol]] + self.tree.rank(np.r_[symbol, symbol], np.r_[lo, hi])
        return both[: len(lo)], both[len(lo) :]

    def _shorten(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> None:
        """Ranges of the same patterns cut to ``length``, in place."""
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            group, first = self.groups(int(k))
            at = group[lo[own]]
            lo[own], hi[own] = first[at], first[at + 1]

    def matching_statistics(self, streams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, group) at each symbol of streams, of which stream i is ``streams[first[i]:first[i + 1]]``: of the longest match,
        up to ``depth``, that begins there and stands in the index; for a match of ``depth`` the group of suffixes, else -1.
        Symbols that the index lacks are -1.

        All streams go from their last symbol to their first in step. What can't be put before a match makes it shorter at its
        end, to what the range's suffixes have in common with their neighbours.
        """
        lengths = np.diff(first)
        by = np.argsort(-lengths, kind="stable")
        last, lengths = first[1:][by] - 1, lengths[by]
        out, found = np.zeros(len(streams), np.int64), np.full(len(streams), -1, np.int64)
        lo, hi, size = np.zeros(len(by), np.int64), np.full(len(by), self.n, np.int64), np.zeros(len(by), np.int64)
        whole, _ = self.groups(self.depth)
        active = len(by)
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths[:active], -step, "left"))
            at = last[:active] - step
            symbol = streams[at]
            full = np.flatnonzero(size[:active] == self.depth)
            if len(full):
                a, b = lo[full], hi[full]
                size[full] = self.depth - 1
                self._shorten(a, b, size[full])
                lo[full], hi[full] = a, b
            gone = symbol < 0
            lo[:active][gone], hi[:active][gone], size[:active][gone] = 0, self.n, 0
            todo = np.flatnonzero(~gone)
            while len(todo):
                a, b = self.extend(symbol[todo], lo[todo], hi[todo])
                fits = b > a
                good, bad = todo[fits], todo[~fits]
                lo[good], hi[good] = a[fits], b[fits]
                size[good] += 1
                rest = size[bad] > 0
                none, bad = bad[~rest], bad[rest]
                lo[none], hi[none] = 0, self.n
                if len(bad):
                    size[bad] = np.minimum(size[bad] - 1, np.maximum(self.common[lo[bad]], self.common[hi[bad]]))
                    a, b = lo[bad], hi[bad]
                    self._shorten(a, b, size[bad])
                    lo[bad], hi[bad] = a, b
                todo = bad
            out[at] = size[:active]
            hit = size[:active] == self.depth
            found[at[hit]] = whole[lo[:active][hit]]
        return out, found
