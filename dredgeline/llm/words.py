"""Words and word-sequence hashes of whole Arrow text columns, in numpy.

A word is a maximal run of characters other than the six ASCII white-space characters, so words
can be cut on UTF-8 bytes. Hashes are 64 bits wide; the chance that two given different words or
sequences agree is about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
S29, S32, S31 = np.uint64(29), np.uint64(32), np.uint64(31)
#: Longer words are hashed one by one.
LONG_WORD = 64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the number of the first word of every row (one more at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    ink = np.zeros(len(data) + 2, dtype=bool)
    ink[1:-1] = ~SPACE[data]
    start, end = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] |= ink[1:-1][edge]
    end[edge - 1] |= ink[1:-1][edge - 1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * K3
    return h ^ (h >> S29)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts, in order."""
    return mix(a * K1 + (b ^ (b >> S31)) * K2)


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word."""
    size = end - first
    h = size.astype(np.uint64) * K2 + np.uint64(seed)
    live = np.flatnonzero(size <= LONG_WORD)
    at, left, cur = first[live], size[live], h[live]
    step = 0
    while len(live):
        more = left > step
        if not more.all():
            h[live[~more]] = cur[~more]
            live, at, left, cur = live[more], at[more], left[more], cur[more]
            if not len(live):
                break
        cur = (cur + data[at + step] + np.uint64(1)) * K1
        cur ^= cur >> S32
        step += 1
    for i in np.flatnonzero(size > LONG_WORD):
        d = hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = np.frombuffer(d, np.uint64)[0]
    return mix(h)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` elements that start at each position (for the positions that have them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, width, power = None, 0, 1, h
    while True:  # the bits of n, each taken from the power of two of that width
        if n & width:
            piece = power[have : len(h) - n + 1 + have]
            out = piece if out is None else fold(out[: len(piece)], piece)
            have += width
        if width * 2 > n:
            return out
        power = fold(power[:-width], power[width:])
        width *= 2


class Lookup:
    """Open-addressing table from 64-bit keys to positions, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        size = 1 << max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        keys = keys.astype(np.uint64)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several that want a slot one stays
            self.keys[slot[free]] = keys[todo[free]]
            placed = self.at[slot] == todo
            self.keys[slot[placed]] = keys[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K1) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._home(keys)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.at[slot]
            done = (got < 0) | (self.keys[slot] == keys[todo])
            out[todo[done]] = got[done]
            todo, slot = todo[~done], slot[~done]
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] values, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - ends + counts, counts)


def release() -> None:
    """Give freed Arrow memory back to the system between batches."""
    pa.default_memory_pool().release_unused()
