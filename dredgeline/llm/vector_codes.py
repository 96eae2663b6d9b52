"""Compression of vectors to short codes by exact integer product quantisation.

Components become integers, vectors are cut into equal parts, and every part position has a codebook
that Lloyd rounds improve. A distance is |x|^2 - 2 x.c + |c|^2 with the product from a matrix
multiplication: integers are broken into limbs so short that a sum of products of two of them stays
below 2**53, where float64 is exact; the limb products are put together again in int64. That wraps
around, but the true distance fits, so the result is exact, and equal on any machine and number of threads.
Rows so large that a distance might not fit 63 bits go through Python integers instead.

A round is one pass over the table: tasks assign and add up limbs per (part, entry), Spark adds the
tasks' sums, and the driver gets one codebook's worth of numbers, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from dredgeline.llm.store import scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096.0, 8, 16, 6
#: What a long can hold of floor(scale * x); larger components are set to it.
LARGEST = 2**62
#: Rows multiplied at once.
BLOCK = 1 << 14
#: Groups in which tasks' smallest ids meet before all do.
GROUPS = 64
#: Sums of labels up to this many rows (some 24 bytes each) are broadcast.
SMALL = 200_000
Books = dict[int, list[np.ndarray]]


def integer_rows(column: pa.Array | pa.ChunkedArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each dimension among the rows without null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        with np.errstate(over="ignore"):
            v = np.floor(x[(end - size)[rows, None] + np.arange(d)] * scale)
        yield rows, np.clip(v, -float(LARGEST), float(LARGEST)).astype(np.int64)


def cut(d: int, parts: int) -> list[slice]:
    """Where the parts of a vector begin and end; lengths differ by one at most if ``parts`` does not divide d."""
    return [slice(d * i // parts, d * (i + 1) // parts) for i in range(parts)]


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two limbs add up to less than 2**53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` = sum of limb j times 2**(bits * j); all but the last, signed one are not negative."""
    out = []
    while len(a) and a.size and max(abs(int(a.max())), abs(int(a.min()))) >> bits:
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """x @ y.T in int64 (modulo 2**64) from float64 matrix products that are each exact."""
    total = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << bits * (i + j)
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of every row, and its squared distance (as Python integers past 63 bits)."""
    width = x.shape[1]
    fits = 1 << (61 - max(1, width).bit_length()) // 2  # then (2 * fits)**2 * width < 2**63
    if not width:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    wide = (np.abs(x) >= fits).any(axis=1) | bool((np.abs(book) >= fits).any())
    code, best = np.zeros(len(x), np.int64), np.zeros(len(x), object if wide.any() else np.int64)
    for at in range(0, len(x), BLOCK):
        rows = at + np.flatnonzero(~wide[at : at + BLOCK])
        if len(rows):
            a = x[rows]
            dist = (a * a).sum(axis=1)[:, None] - 2 * products(a, book, limb_bits(width)) + (book * book).sum(axis=1)
            code[rows] = dist.argmin(axis=1)
            best[rows] = dist[np.arange(len(rows)), code[rows]]
    for r in np.flatnonzero(wide):
        dist = [sum((int(p) - int(q)) ** 2 for p, q in zip(x[r], entry, strict=True)) for entry in book]
        code[r] = dist.index(min(dist))
        best[r] = min(dist)
    return code, best


def _smallest(scale: float, entries: int):
    """Per task and dimension, the vectors with the smallest ids; equal ids by the vector, null ids last."""
    schema = pa.schema([("dim", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            for at, v in integer_rows(batch.column("embedding"), scale):
                d = v.shape[1]
                own = [(ids[r] is None, ids[r] or 0) for r in at]
                limit = sorted(own)[: entries][-1]
                new = [(*key, tuple(v[k].tolist())) for k, key in enumerate(own) if key <= limit]
                held[d] = sorted(held.get(d, []) + new)[:entries]
        out = [(d, None if none else i, list(v)) for d, found in held.items() for none, i, v in found]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows, "dim int, vec_id long, v array<long>"


def first_books(vectors: DataFrame, scale: float, parts: int, entries: int) -> Books:
    """Codebooks from the vectors with the smallest ids, by dimension: ``entries`` rows each, or all if fewer."""
    found = vectors.mapInArrow(*_smallest(scale, entries)).withColumn("some", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    order = F.col("vec_id").asc_nulls_last(), F.col("v")
    for key in (["dim", "some"], ["dim"]):
        found = found.withColumn("k", F.row_number().over(Win.partitionBy(*key).orderBy(*order))).where(F.col("k") <= entries)
    rows: dict[int, list] = {}
    for r in sorted(found.select("dim", "k", "v").collect(), key=lambda r: (r.dim, r.k)):
        rows.setdefault(r.dim, []).append(r.v)
    return {d: [np.array(v, np.int64).reshape(len(v), d)[:, s] for s in cut(d, parts)] for d, v in rows.items()}


def _sums(books, scale: float, parts: int):
    """Per task: rows and limb sums of every (dimension, part, entry). slot is limb * width + position; -1 holds the number of rows."""
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("slot", pa.int32()), ("s", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}  # (dimension, part, limb): entries x width
        count: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, v in integer_rows(batch.column("embedding"), scale):
                d = v.shape[1]
                for p, s in enumerate(cut(d, parts)):
                    book = books.value[d][p]
                    for at in range(0, len(v), BLOCK):
                        x = np.ascontiguousarray(v[at : at + BLOCK, s])
                        code, _ = nearest(x, book)
                        own = (code[:, None] == np.arange(len(book))).astype(np.float64)
                        count[d, p] = count.get((d, p), 0) + own.sum(axis=0).astype(np.int64)
                        for j, limb in enumerate(limbs(x, limb_bits(x.shape[1]))):
                            total[d, p, j] = total.get((d, p, j), 0) + (own.T @ limb).astype(np.int64)
        out = [(d, p, e, -1, int(n)) for (d, p), c in count.items() for e, n in enumerate(c) if n]
        out += [(d, p, e, j * t.shape[1] + k, int(t[e, k])) for (d, p, j), t in total.items() for e, k in zip(*np.nonzero(t), strict=True)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows, "dim int, part int, entry int, slot int, s long"


def improved(vectors: DataFrame, books: Books, scale: float, parts: int) -> Books:
    """One round: every entry becomes the floor of the mean of its parts; entries without parts stay."""
    spark = vectors.sparkSession
    fn, schema = _sums(spark.sparkContext.broadcast(books), scale, parts)
    sums = vectors.mapInArrow(fn, schema).groupBy("dim", "part", "entry", "slot").agg(F.sum("s").alias("s"))
    totals: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in sums.collect():  # a few numbers for each number in the codebooks
        totals.setdefault((r.dim, r.part, r.entry), {})[r.slot] = r.s
    new = {d: [b.copy() for b in own] for d, own in books.items()}
    for (d, p, e), slots in totals.items():
        width, n = new[d][p].shape[1], slots.pop(-1)
        bits, whole = limb_bits(width), [0] * width
        for slot, s in slots.items():
            whole[slot % width] += s << bits * (slot // width)
        new[d][p][e] = [x // n for x in whole]
    return new


def _assign(books, scale: float, parts: int, label: pa.DataType, digests: dict[int, str]):
    names = ["vec_id", "label", "code", "error", "codebooks_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in integer_rows(batch.column("embedding"), scale):
                found = [nearest(np.ascontiguousarray(v[:, s]), books.value[v.shape[1]][p]) for p, s in enumerate(cut(v.shape[1], parts))]
                hexes = [[f"{c:02x}" for c in code] for code, _ in found]
                error = [min(sum(map(int, x)), 2**63 - 1) for x in zip(*(e for _, e in found), strict=True)]
                take = pa.array(at)
                yield pa.record_batch([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(["".join(x) for x in zip(*hexes, strict=True)]), pa.array(error, pa.int64()), pa.array([digests[v.shape[1]]] * len(at))], names=names)

    return rows


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def learn(vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks by dimension: a matrix of entries for each part. ``vectors`` has (vec_id, embedding)."""
    books = first_books(vectors, scale, parts, entries)
    for _ in range(rounds):
        books = improved(vectors, books, scale, parts)
    return books


def encode(vectors: DataFrame, books: Books, scale: float = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every usable row."""
    spark = vectors.sparkSession
    digests = {d: books_digest(b) for d, b in books.items()}
    fn = _assign(spark.sparkContext.broadcast(books), scale, parts, None, digests)
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(fn, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for every usable vector.

    Vectors that are null or hold a null or non-finite component go; an empty vector has the code of
    zeros and error 0. Each dimension has codebooks of its own, and with fewer rows than ``entries``
    as many entries as rows. Rows with one vec_id are rows of their own, smaller vectors first; a
    null vec_id comes last and is returned. Null labels form one group. Integers past +-2**62 are set
    to that, and errors end at 2**63 - 1. An empty table gives an empty result; other columns are
    ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    books = learn(slim.select("vec_id", "embedding"), scale, parts, entries, rounds)
    coded = scratch(encode(slim, books, scale, parts), "vector-codes")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = scratch(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    sums = F.broadcast(sums) if sums.count() <= SMALL else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
