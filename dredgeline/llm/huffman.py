"""Canonical length-limited Huffman codes: lengths from counts, packing, table-driven unpacking."""

from __future__ import annotations

import numpy as np

from dredgeline.llm import words as W

LIMIT = 18
#: Ids from one bit-offset checkpoint to the next.
EVERY = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of every symbol (0: not used), by package-merge: optimal under the limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf, current = [], weight
    for _ in range(limit - 1):
        leaf.append(None)
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, packages))
        sort = np.argsort(both, kind="stable")
        current, leaf[-1] = both[sort], sort < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = self.lengths[order]
        self.top = int(size.max(initial=1))
        # Canonical: codes in order of length and symbol, each the next number of its length.
        firsts = np.concatenate(([0], np.cumsum(np.int64(1) << (self.top - size))))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (firsts[:-1] >> (self.top - size)).astype(np.uint64)
        # Entry of every string of ``top`` bits: symbol and length of the code it begins with.
        self.table = np.zeros(1 << self.top, np.int64)
        self.table[: firsts[-1]] = np.repeat(order * 64 + size, np.int64(1) << (self.top - size))

    def pack(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all rows (each from a whole byte on), bytes per row, and bit offsets in the row at every EVERY-th id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        first = np.concatenate(([0], np.cumsum(counts)))
        bits = np.concatenate(([0], end))[first]
        n_bytes = (np.diff(bits) + 7) // 8
        base = np.concatenate(([0], np.cumsum(n_bytes)))
        at = end - size + np.repeat(base[:-1] * 8 - bits[:-1], counts)
        word, off = at >> 5, (at & 31).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - size.astype(np.uint64) - off)
        out = np.zeros((int(base[-1]) * 8 + 31) // 32 + 2, np.uint32)
        if len(ids):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            # The bits of different ids do not overlap, so sums join them.
            high = np.add.reduceat(value >> np.uint64(32), begin)
            low = np.add.reduceat(value & np.uint64(0xFFFFFFFF), begin)
            out[word[begin]] |= high.astype(np.uint32)
            out[word[begin] + 1] |= low.astype(np.uint32)
        points = (counts + EVERY - 1) // EVERY
        mark = W.ragged(np.zeros(len(counts), np.int64), points) * EVERY + np.repeat(first[:-1], points)
        offsets = np.concatenate(([0], end))[mark] - np.repeat(bits[:-1], points)
        return out.astype(">u4").view(np.uint8)[: int(base[-1])], n_bytes, offsets.astype(np.int32)

    def unpack(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all lanes, one after the other: lane k has ``counts[k]`` ids (EVERY at most) from bit ``starts[k]`` on."""
        window = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
        window = window[:-3] << 24 | window[1:-2] << 16 | window[2:-1] << 8 | window[3:]  # the 32 bits from each byte on
        out = np.zeros(int(counts.sum()), np.int64)
        to = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, to, left = starts[order].astype(np.int64), to[order], counts[order]
        shift, mask = 32 - self.top, (1 << self.top) - 1
        for step in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(-left, -step, side="left"))  # lanes in falling order of length
            a = at[:live]
            entry = self.table[(window[a >> 3] >> (shift - (a & 7)).astype(np.uint32)) & mask]
            out[to[:live] + step] = entry >> 6
            at[:live] = a + (entry & 63)
        return out
