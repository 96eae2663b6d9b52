"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms describe how a text is written, not what it is about: trigrams of character classes, the
lengths of the text and of its words, the share of distinct words and lines. On a bounded sample of labelled
documents (``PER_CLASS`` of each label, by the order of a hash) the weighted term matrix is
factored; its leading directions are the latent space. The sample's vectors and labels are broadcast.
Every document is projected, its cosines with all sample vectors are taken in blocks of one matrix
product, and its ``K`` nearest ones vote with the weight of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.llm import words as W

PER_CLASS, K, DIMENSIONS, SHARP, THRESHOLD = 1000, 15, 48, 8.0, 0.7
#: Classes of bytes: white space, line end, capital, small letter, digit, bytes beyond ASCII, and the marks one by one.
CLASS = np.full(256, 6, np.int64)
CLASS[:33] = 0
CLASS[10] = 1
CLASS[65:91] = 2
CLASS[97:123] = 3
CLASS[48:58] = 4
CLASS[128:] = 5
for _k, _c in enumerate(b".,!?|#*$%&<>'\"-"):
    CLASS[_c] = 7 + _k
SYMBOLS = 22
SHAPES = SYMBOLS**3
BANDS = 24
TERMS = SHAPES + 4 * BANDS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weighted terms of every row, as a dense matrix over the hashed shapes and the bands."""
    rows = len(offsets) - 1
    out = np.zeros((rows, TERMS), np.float32)
    first, end, row = W.spans(data, offsets)
    h = W.hashes(data, first, end)
    for k in range(rows):
        x = CLASS[data[offsets[k] : offsets[k + 1]]]
        n = int(row[k + 1] - row[k])
        if len(x) > 2:
            shape = np.bincount(x[:-2] * SYMBOLS**2 + x[1:-1] * SYMBOLS + x[2:], minlength=SHAPES)
            out[k, :SHAPES] = np.sqrt(shape / len(x))
        w = h[row[k] : row[k + 1]]
        distinct = len(np.unique(w)) / n if n else 0.0
        windows = W.runs(w, 3)
        fresh = len(np.unique(windows)) / len(windows) if len(windows) else 0.0
        size = float((end[row[k] : row[k + 1]] - first[row[k] : row[k + 1]]).mean()) if n else 0.0
        for band, value in enumerate((2 * np.log2(n + 1), distinct * (BANDS - 1), fresh * (BANDS - 1), size)):
            low = min(BANDS - 2.0, max(0.0, value))
            a = int(low)
            # A value between two bands counts for both.
            out[k, SHAPES + band * BANDS + a], out[k, SHAPES + band * BANDS + a + 1] = 0.5 * (1 - low + a), 0.5 * (low - a)
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, off = W.utf8(batch.column("text"))
    for i, j in W.chunks(off):
        for a in range(i, j, 512):
            b = min(j, a + 512)
            yield a, b, features(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x in _blocks(batch):
            at = [np.flatnonzero(r) for r in x]
            yield pa.record_batch([
                batch.column("quality").slice(a, b - a), pa.array([t.astype(np.int32).tobytes() for t in at], pa.binary()), pa.array([r[t].tobytes() for r, t in zip(x, at, strict=True)], pa.binary()),
            ], names=["quality", "at", "x"])


class Space:
    """Projection and the sample's vectors: bounded by the sample's size."""

    def __init__(self, x: np.ndarray, label: np.ndarray, dimensions: int = DIMENSIONS) -> None:
        seen = (x > 0).sum(axis=0)
        self.terms = np.flatnonzero(seen > 1)
        self.idf = np.log1p(len(x) / seen[self.terms]).astype(np.float32)
        y = x[:, self.terms] * self.idf
        self.mean = y.mean(axis=0)
        y = y - self.mean
        # Leading right singular vectors from the smaller of the two Gram matrices.
        if len(y) < len(self.terms):
            value, left = np.linalg.eigh(y @ y.T)
            keep = [k for k in range(len(value) - 1, max(-1, len(value) - 1 - dimensions), -1) if value[k] > 1e-6]
            self.axes = (y.T @ left[:, keep]) / np.sqrt(np.maximum(value[keep], 1e-12))
        else:
            value, right = np.linalg.eigh(y.T @ y)
            self.axes = right[:, ::-1][:, :dimensions]
        self.axes = self.axes.astype(np.float32)
        self.vectors, self.label = self._unit(y @ self.axes), label.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, x: np.ndarray, k: int = K) -> np.ndarray:
        v = self._unit((x[:, self.terms] * self.idf - self.mean) @ self.axes)
        near = v @ self.vectors.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, top, axis=1).astype(np.float64)
        weight = np.exp(SHARP * (sim - sim.max(axis=1, keepdims=True)))
        return (weight * self.label[top]).sum(axis=1) / weight.sum(axis=1)


def in_fold(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Space | None:
    """The space of a sample of at most ``per_class`` labelled training documents of each label; None without any.

    The class of clean documents is not reweighted: both get equal room in the sample, and votes count as they fall.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for q in (0, 1):
        one = known.where(F.col("quality") == q).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionAll(one)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))
    rows = sample.select("quality", "text").mapInArrow(_describe, "quality int, at binary, x binary").toArrow()
    if not len(rows):
        return None
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, (at, v) in enumerate(zip(rows.column("at").to_pylist(), rows.column("x").to_pylist(), strict=True)):
        x[k, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    return Space(x, rows.column("quality").to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = K) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score of 0.7 or more) of every document.

    Only the text decides a score; null text is the empty text. Labels other than 0 and 1 are not
    used, of several labels of a document the larger one is; labelled rows without a document are
    ignored. Without usable labels every score is 0.5. Equal texts score equally; a null doc_id
    stays null and counts as the empty text in the fold. An empty table gives an empty table.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = space.value
        for batch in batches:
            for a, b, x in _blocks(batch):
                score = np.full(b - a, 0.5) if model is None else model.vote(x, k)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), score, (score >= THRESHOLD).astype(np.int32)], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", in_fold(F.col("doc_id")).alias("held_out")).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
