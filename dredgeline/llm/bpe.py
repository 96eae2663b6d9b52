"""Byte-level BPE on padded matrices.

The distinct pre-tokens of a batch that are no tokens themselves go into matrices by length bucket, a
row each, padded on the right. In each round every row merges its leftmost pair of minimum rank:
the ranks of neighbouring pairs come from a hashed pair table, only the two pairs at the merge are looked up
again, and rows without a pair left are taken out. A pre-token of over ``WIDE`` bytes merges all
(non-overlapping) places of its minimum rank in one round where that gives the same: if no pair with
the new token ranks before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.llm import words as W
from dredgeline.llm.pieces import Pieces

NONE = np.int32(2**31 - 1)
WIDE = 64
#: Cells of a matrix.
CELLS = 1 << 19
#: Distinct pre-tokens that a worker keeps.
KEPT = 100_000
_workers: dict[tuple[str, str], "Vocabulary"] = {}


class Vocabulary:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # Two neighbours merge if their bytes together are a token: every cut of every token.
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs, self.rank = W.Lookup((a << 32 | b).astype(np.uint64)), np.concatenate((c, [NONE])).astype(np.int32)
        # Tokens whose own pairs all rank behind them: such a merge brings up no pair that goes before it.
        self.safe = np.ones(int(max(self.token)) + 1, bool)
        for part in (a, b):
            self.safe[part[c < part]] = False
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, np.ndarray] = {}
        self.pieces = Pieces(self.encode)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it makes no token (padding is -1)."""
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64)
        return np.where((a < 0) | (b < 0), NONE, self.rank[self.pairs.find(key)])

    def narrow(self, m: np.ndarray, out: list, at: np.ndarray) -> None:
        """Merge all rows of a padded matrix to the end; out[at[k]] becomes row k's ids."""
        rank = self.look(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(m):
            if rank.shape[1] == 0:
                best = np.full(len(m), NONE)
            else:
                place = rank.argmin(axis=1)
                best = rank[np.arange(len(m)), place]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[at[k]] = m[k][m[k] >= 0]
            if done.all():
                return
            live = ~done
            m, rank, at, place, best = m[live], rank[live], at[live], place[live], best[live]
            n, row = m.shape[1], np.arange(len(m))
            m[row, place] = best
            # Close the gap right of the merge; the matrix gets one column less.
            m = m[row[:, None], np.arange(n - 1) + (np.arange(n - 1) > place[:, None])]
            rank = rank[row[:, None], np.arange(n - 2) + (np.arange(n - 2) >= place[:, None])]
            if n > 2:
                left = np.flatnonzero(place > 0)
                rank[left, place[left] - 1] = self.look(m[left, place[left] - 1], m[left, place[left]])
                right = np.flatnonzero(place < n - 2)
                rank[right, place[right]] = self.look(m[right, place[right]], m[right, place[right] + 1])

    def wide(self, ids: np.ndarray) -> np.ndarray:
        rank = self.look(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if self.safe[best]:  # of places side by side every second one
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = at[:1]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            now = at - np.arange(len(at))
            for k in (now - 1, now):
                k = k[(k >= 0) & (k < len(rank))]
                rank[k] = self.look(ids[k], ids[k + 1])
        return ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT:
            self.known = {}
        known, none = self.known, np.zeros(0, np.int32)
        cut = [self.cut(p.decode()) for p in pieces]
        new = list({p for parts in cut for p in parts if p not in known})
        raw = [p.encode() for p in new]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        todo = []
        for k, t in enumerate(raw):
            if (r := self.ranks.get(t)) is not None:
                out[k] = np.array([r], np.int32)
            else:
                todo.append(k)
        todo.sort(key=lambda k: len(raw[k]))
        size = np.array([len(raw[k]) for k in todo], np.int64)
        width, i = 4, 0
        while i < len(todo):
            if size[i] > WIDE:
                for k in todo[i:]:
                    out[k] = self.wide(self.byte[np.frombuffer(raw[k], np.uint8)].copy())
                break
            while width < size[i]:
                width *= 2
            stop = min(int(np.searchsorted(size, width, side="right")), i + max(1, CELLS // width))
            rows = todo[i:stop]
            m = np.full((len(rows), width), -1, np.int32)
            m[np.arange(width) < size[i:stop, None]] = self.byte[np.frombuffer(b"".join(raw[k] for k in rows), np.uint8)]
            self.narrow(m, out, np.array(rows))
            i = stop
        known.update(zip(new, out, strict=True))
        found = [known[p] for parts in cut for p in parts]
        size = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        return np.concatenate([none, *found]), np.diff(size[np.concatenate(([0], np.cumsum([len(parts) for parts in cut])))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One a worker process."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Vocabulary(path, pattern)
    return _workers[path, pattern]


def _encode(path: str, pattern: str, decoded: bool):
    names = ["rest", "text", "ids"] + ["decoded"] * decoded

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            data, off = W.utf8(batch.column("text"))
            for i, j in W.chunks(off):
                flat, n = v.pieces.rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
                stop = np.concatenate(([0], np.cumsum(n)))
                out = [batch.column("rest").slice(i, j - i), batch.column("text").slice(i, j - i), pa.ListArray.from_arrays(stop.astype(np.int32), flat)]
                if decoded:
                    out.append(pa.array([v.decode(flat[a:b].tolist()) for a, b in zip(stop[:-1], stop[1:], strict=True)], pa.binary()))
                yield pa.record_batch(out, names=names)
            del data, off, batch
            W.release()

    return rows


def encode_rows(docs: DataFrame, path: str, pattern: str, decoded: bool = True) -> DataFrame:
    """All columns of ``docs`` with ids (and decoded, the ids' bytes) after them; see :func:`encode`.

    Columns of ``docs`` that are called so already are left out: the new ones take their place.
    """
    new = ["ids", *["decoded"] * decoded]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    schema = T.StructType([T.StructField("rest", packed.schema["rest"].dataType), *T.StructType.fromDDL("text string, ids array<int>" + ", decoded binary" * decoded)])
    out = packed.mapInArrow(_encode(path, pattern, decoded), schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns), *new)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every text, by the ranks in ``path`` and the pre-token ``pattern``; with ``decoded`` also the bytes of those ids.

    Null text is the empty text and has no ids. Any length of text or pre-token is encoded whole.
    Equal rows give equal rows, a null doc_id stays null, an empty table gives an empty table, other
    columns are ignored.
    """
    return encode_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, pattern, decoded).drop("text")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (bytes) of rows (doc_id, ids); null ids give empty bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([v.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, decoded binary")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
