"""A compressed FM-index of a sequence of symbols, with backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self._words = words
        self._before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self._before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self._words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Symbols level by level, one packed bit a symbol and level, in the matrix layout."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self._levels, self._zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self._levels.append(BitVector(bit.astype(np.uint8)))
            ones = bit.astype(bool)
            self._zeros.append(len(now) - int(ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` symbols."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (vector, zeros) in enumerate(zip(self._levels, self._zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = vector.ones(low), vector.ones(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text in the order of their first ``depth`` symbols or more, shorter first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth and rank[order[-1]] < n:
        key = rank * (n + 2)
        key[: n - known] += rank[known:]
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        known *= 2
    return order


class FMIndex:
    """Backward search over a text of symbols 1.. (0 ends it), for patterns shorter than ``depth``.

    ``heavy`` marks places of the text that count twice. The suffix array is used to build the index and
    not kept: what stays is one packed bit a symbol and level, counts before every 64 of them, and a bit
    for heavy places.
    """

    def __init__(self, text: np.ndarray, heavy: np.ndarray, depth: int):
        text, heavy = np.append(text, 0), np.append(heavy, False)
        order = suffix_order(text, depth)
        top = int(text.max())
        self._tree = WaveletTree(text[order - 1].astype(np.int64), max(1, top.bit_length()))
        self._first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self._heavy = BitVector(heavy[order].astype(np.uint8))
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        n = len(low)
        rank = self._tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self._first[symbol]
        return base + rank[:n], base + rank[n:]

    def repeated(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an interval holds two places or a heavy one."""
        width = high - low
        single = width == 1
        out = width > 1
        out[single] = self._heavy[low[single]] == 1
        return out


def repeats(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matching statistics: the least start from which text[start:end] is still found twice, by range."""
    start = end.copy()
    low, high = np.zeros(len(end), np.int64), np.full(len(end), index.size, np.int64)
    active = np.flatnonzero(begin < end)
    while len(active):
        at = start[active] - 1
        a, b = index.extend(text[at], low[active], high[active])
        good = index.repeated(a, b)
        active, a, b, at = active[good], a[good], b[good], at[good]
        low[active], high[active], start[active] = a, b, at
        active = active[at > begin[active]]
    return start


def repeated_windows(text: np.ndarray, begin: np.ndarray, end: np.ndarray, heavy: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment [begin, end) of a text, starts (from its begin) of windows found twice in the text.

    Each segment is searched from its end to the left as far as it is found twice; windows within that
    stretch are repeated, and those that start before it are searched one by one. Segments are separated
    in ``text`` by symbols that no window has. ``heavy`` segments count twice.
    """
    marks = np.zeros(len(text), bool)
    for b, e in zip(begin[heavy], end[heavy]):
        marks[b:e] = True
    index = FMIndex(text, marks, 2 * int((end - begin).max(initial=1)))
    reach = repeats(index, text, begin, end)
    owner = np.repeat(np.arange(len(begin)), np.maximum(np.minimum(reach, end - width + 1) - begin, 0))
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]) if len(owner) else np.zeros(0, int)
    offset = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner)))) if len(owner) else np.zeros(0, int)
    start = begin[owner] + offset
    found = repeats(index, text, start, start + width) == start
    single: list[list[int]] = [[] for _ in begin]
    for o, s in zip(owner[found].tolist(), offset[found].tolist()):
        single[o].append(s)
    return [
        np.concatenate([np.array(s, np.int64), np.arange(r - b, e - width + 1 - b)]) for s, r, b, e in zip(single, reach, begin, end)
    ]
