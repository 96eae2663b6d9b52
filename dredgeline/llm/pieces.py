"""Texts as sequences of distinct pieces, so that a tokenizer sees a piece once a worker.

Texts are cut, on their bytes, where the pattern of byte-level pre-tokenizers always ends a pre-token: before ASCII
white space that follows anything else, and between a Latin letter and a following ASCII character that is no letter.
The ids of a text are then those of its pieces, one after the other. Pieces are known by 96 bits of
hashes; a worker keeps a bounded number of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from dredgeline.llm import words as W

#: Distinct pieces that a worker keeps.
KEPT = 1_000_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: White space in any reading of it: control characters 28 to 31 count in some.
BLANK = W.SPACE.copy()
BLANK[28:32] = True
K4 = np.uint64(0xA24BAED4963EE407)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every piece; rows that have bytes begin one."""
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    if len(data) > 1:
        p, x = data[:-1], data[1:]
        space = np.flatnonzero(W.SPACE[x] & ~BLANK[p]) + 1
        # The character before may be white space beyond ASCII.
        wide = space[data[space - 1] >= 0x80]
        one, two, three = data[wide - 1], data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        general = (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | np.isin(one, (0xA8, 0xA9, 0xAF)))
        other = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & (two == 0x81)) | ((three == 0xE3) & (two == 0x80))
        begin[space] = True
        begin[wide[general | other]] = False
        begin[offsets] = True
        latin = LETTER[p]
        latin[1:] |= (data[:-2] == 0xC3) & (p[1:] >= 0x80) & (p[1:] != 0x97) & (p[1:] != 0xB7)
        begin[1:-1] |= latin & (x < 0x80) & ~LETTER[x]
    return np.flatnonzero(begin[:-1])


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 further bits for every piece."""
    size = end - first
    h, g = size.astype(np.uint64) * W.K2, size.astype(np.uint64)
    live = np.flatnonzero(size <= W.LONG_WORD)
    live = live[np.argsort(-size[live], kind="stable")]  # in falling order of length, so that the live ones are a prefix
    at, left, a, b = first[live], size[live], h[live], g[live]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))
        x = data[at[:n] + step]
        a[:n] = (a[:n] + x + np.uint64(1)) * W.K1
        a[:n] ^= a[:n] >> W.S32
        b[:n] = (b[:n] ^ x) * K4
        b[:n] ^= b[:n] >> W.S29
    h[live], g[live] = a, b
    for i in np.flatnonzero(size > W.LONG_WORD):
        h[i], g[i] = np.frombuffer(hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return W.mix(h), (W.mix(g) >> W.S32).astype(np.uint32)


class _Table:
    """Growing open-addressing table from pieces' hashes to their numbers."""

    def __init__(self) -> None:
        self.n = 0
        self._room(1 << 12)

    def _room(self, size: int) -> None:
        self.size, self.shift = size, np.uint64(64 - size.bit_length() + 1)
        self.h, self.g, self.at = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.full(size, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * W.K1) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & ((self.h[slot] != h) | (self.g[slot] != g)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self.size - 1)
            got = self.at[slot]
            done = (got < 0) | ((self.h[slot] == h[todo]) & (self.g[slot] == g[todo]))
            out[todo[done]] = got[done]
            todo, slot = todo[~done], slot[~done]
        return out

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        """New keys, numbered on."""
        n = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        if self.n * 5 > self.size * 3:
            old = self.at >= 0
            h, g, n = np.concatenate((self.h[old], h)), np.concatenate((self.g[old], g)), np.concatenate((self.at[old], n))
            size = self.size
            while self.n * 5 > size * 3:
                size *= 2
            self._room(size)
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.at[slot] < 0)
            self.at[slot[free]] = n[free]  # of several that want a slot one stays
            mine = self.at[slot] == n
            self.h[slot[mine]], self.g[slot[mine]] = h[mine], g[mine]
            h, g, n, slot = h[~mine], g[~mine], n[~mine], (slot[~mine] + 1) & (self.size - 1)


class Pieces:
    """Turns rows of text into rows of ids; ``encode`` gives ids and number of ids for a list of distinct pieces (bytes)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._reset()

    def _reset(self) -> None:
        self.table = _Table()
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and each row's number of ids."""
        if self.table.n > KEPT:
            self._reset()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        first = cuts(data, offsets[:-1][offsets[:-1] < len(data)])
        end = np.append(first[1:], len(data))
        h, g = hashes(data, first, end)
        at = self.table.find(h, g)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[one]
            text = data.tobytes()
            ids, n = self.encode([text[a:b] for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)])
            at[miss] = self.table.n + back
            self.table.add(h[new], g[new])
            self.flat = np.concatenate((self.flat, ids))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(n)))
        count = self.start[at + 1] - self.start[at]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.flat[W.ragged(self.start[at], count)], np.diff(total[np.searchsorted(first, offsets)])
