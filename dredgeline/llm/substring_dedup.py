"""Substring dedup by seed and extend.

Seeds: every window of ``length`` words picks its smallest hashed ``seed``-word sequence (winnowing),
so two equal windows pick the same seed at the same place. Neighbouring windows with one seed form a
block: a row (seed, block, document, first window, windows). Seeds of one document alone are dropped.

Extension: blocks of equal content are one class, whose smallest document stands for it, so copies
are never paired with each other. A seed whose classes differ is extended both ways in those
smallest documents: one hash for every split of the remaining words left and right of the seed, that is for
every window round it, and the smallest document of each extension is an aggregate. All steps are
linear in the number of seeds, whatever the size of a group.

Maximal repeats: matched windows of a document are joined to maximal spans of at least ``length``
words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.llm import words as W
from dredgeline.llm.store import scratch

LENGTH, SEED = 50, 10
LAST = 2**63 - 1


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of ``width`` neighbours, the leftmost of equals, for every start."""
    at, have = np.arange(len(g)), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    while have * 2 <= width:
        at, have = less(at[:-have], at[have:]), have * 2
    return less(at[: len(at) - (width - have)], at[width - have :]) if have < width else at


def _seed_rows(length: int, seed: int):
    schema = pa.schema([("seed", pa.int64()), ("block", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int16() if length < 2**15 else pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for i, j in W.chunks(off):
                x, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                first, end, row = W.spans(x, o)
                if len(first) < length:
                    continue
                h = W.hashes(x, first, end)
                g, win = W.runs(h, seed), W.runs(h, length)
                pick = winnow(g, length - seed + 1)[: len(win)]
                doc = np.repeat(np.arange(len(o) - 1), np.diff(row))[: len(win)]
                whole = np.arange(len(win)) + length <= row[doc + 1]
                begin = whole.copy()
                begin[1:] &= ~whole[:-1] | (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
                lo = np.flatnonzero(begin)
                if not len(lo):
                    continue
                stop = whole.copy()
                stop[:-1] &= begin[1:] | ~whole[1:]
                hi = np.flatnonzero(stop)
                n = hi - lo + 1
                # Two windows less than their length apart cover all words between: they say what the block is.
                block = W.fold(win[lo], win[hi]) ^ n.astype(np.uint64)
                values = (g[pick[lo]].view(np.int64), block.view(np.int64), did[i:j][doc[lo]], th[i:j][doc[lo]], lo - row[doc[lo]], n)
                yield pa.record_batch([pa.array(v.astype(f.type.to_pandas_dtype()), f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return rows, "seed long, block long, did long, th long, lo int, n " + ("short" if length < 2**15 else "int")


def _window_rows(length: int):
    schema = pa.schema([("seed", pa.int64()), ("ext", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            todo = batch.column("todo")
            for i in range(len(batch)):
                x = data[off[i] : off[i + 1]]
                first, end, _ = W.spans(x, np.array([0, len(x)]))
                win = W.runs(W.hashes(x, first, end), length)
                flat = todo.slice(i, 1).flatten()
                seed, lo, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at = W.ragged(lo.astype(np.int64), n.astype(np.int64))
                yield pa.record_batch([np.repeat(seed, n), win[at].view(np.int64), np.full(len(at), did[i]), np.full(len(at), th[i]), at.astype(np.int32)], schema=schema)

    return rows, "seed long, ext long, did long, th long, lo int"


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents as (did, th, rest, text): a null id counts as the largest, th tells rows of one id apart, rest holds the other columns."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.col("text")).alias("th"),
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("rest"), F.col("text"),
    )


def repeated_spans(keyed: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(did, th, lo, n): windows lo .. lo+n-1 of that document also start in a smaller document."""
    fn, schema = _seed_rows(length, seed)
    seeds = keyed.where(F.col("text").isNotNull()).select("did", "th", "text").mapInArrow(fn, schema)
    seeds = scratch(seeds, "seeds")
    # Rows of equal content are one class before anything meets on the seed alone: a seed that many places share is then as many rows as it has contents.
    classes = seeds.groupBy("seed", "block").agg(F.min("did").alias("least"), F.max("did").alias("most"))
    shared = classes.groupBy("seed").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.count(F.lit(1)).alias("k")).where("a < b")
    live = scratch(classes.join(shared, "seed").select("seed", "block", "least", (F.col("k") > 1).alias("several"), (F.col("least") < F.col("most")).alias("copied")).where("several OR copied"), "seed-classes")
    joined = seeds.join(live, ["seed", "block"])
    copies = joined.where("did > least").select("did", "th", "lo", F.col("n").cast("int").alias("n"))
    todo = (
        joined.where("did = least AND several")
        .groupBy("did", "th").agg(F.collect_list(F.struct("seed", "lo", "n")).alias("todo"))  # at most one entry a window of the text
    )
    fn, schema = _window_rows(length)
    # All columns of ``keyed`` stay, so that this join and the caller's share one exchange of the texts.
    windows = keyed.join(todo, ["did", "th"]).select("did", "th", "rest", "text", "todo").mapInArrow(fn, schema)
    least = windows.groupBy("seed", "ext").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most")
    matched = windows.join(least, ["seed", "ext"]).where("did > least").select("did", "th", "lo", F.lit(1).alias("n"))
    return copies.unionAll(matched)


def _cut(length: int, with_text: bool):
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))]
    fields += [("kept_text", pa.string())] if with_text else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column("text"))
            found, nulls = batch.column("found"), batch.column("text").is_null()
            for i, j in W.chunks(off, 8 << 20):
                out: list[list] = [[] for _ in fields]
                for k in range(i, j):
                    text = data[off[k] : off[k + 1]].tobytes()
                    words = text.split()
                    total, cuts = len(words), []
                    if found[k].is_valid and len(found[k]):
                        flat = found.slice(k, 1).flatten()
                        lo, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                        edge = np.zeros(total + 1, np.int64)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, lo + n + length - 1, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                        begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                        cuts = [{"first": int(a), "n": int(b - a)} for a, b in zip(begin, stop, strict=True)]
                        words = [w for a, b in zip(np.concatenate(([0], stop)), np.concatenate((begin, [total])), strict=True) for w in words[a:b]]
                    kept = b" ".join(words)
                    row = [total, total - len(words), hashlib.sha256(kept).hexdigest(), cuts]
                    if with_text:  # an untouched text keeps its white space
                        row.append(None if nulls[k].as_py() else (kept if cuts else text).decode("utf-8", "replace"))
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                yield pa.record_batch([batch.column("rest").slice(i, j - i)] + [pa.array(v, kind) for v, (_, kind) in zip(out, fields, strict=True)], names=["rest"] + [n for n, _ in fields])

    return rows


def _cut_documents(docs: DataFrame, columns: list[str], length: int, seed: int, with_text: bool) -> DataFrame:
    keyed = _keyed(docs, columns)
    found = repeated_spans(keyed, length, seed).groupBy("did", "th").agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    rows = keyed.join(found, ["did", "th"], "left")
    ddl = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,n:int>>" + ", kept_text string" * with_text
    schema = T.StructType([T.StructField("rest", keyed.schema["rest"].dataType), *T.StructType.fromDDL(ddl)])
    return rows.select("rest", "text", "found").mapInArrow(_cut(length, with_text), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """One row per document: counts, digest, the maximal repeated spans (word positions) and, if asked, the kept text.

    A word goes if a window of ``length`` words round it also starts in a document with a smaller
    ``doc_id``. Null text: no words (null stays null). Texts under ``length`` words stay whole.
    Rows with one ``doc_id`` never cut each other; a null ``doc_id`` counts as the largest. Equal
    rows give equal rows. An empty table gives an empty table; other columns are ignored.
    """
    return _cut_documents(docs, ["doc_id"], length, seed, with_text).select("rest.doc_id", "n_words", "n_removed", "kept_sha256", "spans", *["kept_text"] * with_text)


def cut_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated words gone from ``text`` (see :func:`remove_repeats`); texts without any stay as they are, all other columns too."""
    rest = [c for c in docs.columns if c != "text"]
    out = _cut_documents(docs, rest, length, seed, True)
    return out.select(*(F.col("kept_text").alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))
