"""Words of whole texts as numpy arrays over their UTF-8 bytes.

The separators (space, U+0009 to U+000D) are single ASCII bytes, so words are runs of other bytes. Words
and runs of words are hashed by array operations, so no Python code runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text worked on at once; a longer single text is worked on alone
CHUNK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_ODD, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
#: ranges of more bytes are hashed one by one
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in ranges [start, end), equal for equal bytes.

    Eight bytes are mixed in at once and every step mixes all bits, so no family of byte strings collides
    by its structure. Ranges longer than ``LONG`` bytes are hashed by BLAKE2.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _ODD + _SEED)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        piece = eight[start[live] + at]
        part = left < 8
        piece[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[live] = mix((out[live] ^ piece) * _ODD + _SEED)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class RunHash:
    """64-bit hashes of runs [a, b) of a sequence of keys, equal for equal runs.

    A run is hashed from the two longest stretches of a power of two that cover it; stretches are hashed
    from their halves with every bit mixed. ``salt`` gives independent families.
    """

    def __init__(self, keys: np.ndarray, salt: int = 0):
        self._salt = mix(np.array([salt], np.uint64) + _SEED)[0]
        self._levels = [mix(keys ^ self._salt)]

    def _level(self, k: int) -> np.ndarray:
        while len(self._levels) <= k:
            low, step = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(mix(low[: max(len(low) - step, 0)] * _ODD + (low[step:] ^ self._salt)))
        return self._levels[k]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = b - a
        out = np.zeros(len(a), np.uint64)
        power = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(power[size > 0]).tolist():
            own = np.flatnonzero((power == k) & (size > 0))
            level = self._level(k)
            out[own] = mix(level[a[own]] * _ODD + (level[b[own] - (1 << k)] ^ (size[own].astype(np.uint64) * _SEED)))
        return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text, or one row."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words of a column of texts: ``start`` and ``end`` bytes, ``first`` word of each text, 64-bit ``key``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        separator = SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~separator
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= separator[:-1] | edge[1:n]
            ends[:-1] &= separator[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def keys(self) -> np.ndarray:
        return range_keys(self.data, self.start, self.end)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + size)``."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
