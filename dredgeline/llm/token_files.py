"""Token-id files: canonical length-limited Huffman codes from global counts, independent blocks.

A folder holds three Parquet tables, written by Spark and so whole or absent after a lost executor:

``blocks``  a row per block of whole documents: part and block number, the block's first id counted
            from its part's, the documents' ids, numbers of ids and of bytes, the packed codes (each document
            from a whole byte on) and the bit offset in its document of every 128th id
``parts``   first id of each part, parts being runs of ascending doc_id
``code``    code length of every id in use; the codes are the canonical ones

A block needs nothing but the code to be read, and reading may start at any checkpoint.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredgeline.llm import huffman
from dredgeline.llm import words as W
from dredgeline.llm.pieces import Pieces
from dredgeline.llm.store import scratch

END_ID = 0
#: Ids in a block (the last document may exceed them) and in a part, about.
BLOCK, PART = 1 << 16, 1 << 20
#: Most parts: beyond them parts grow, and a part is a task.
MOST_PARTS = 1 << 16
#: White space, and first bytes of white space beyond ASCII: pieces with them are encoded alone.
ODD = frozenset((9, 10, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3))
_workers: dict[str, Pieces] = {}


def library_pieces(path: str) -> Pieces:
    """Encoder of a tokenizers file, one a worker process; strings of special tokens are ordinary text."""
    if path not in _workers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        vocab = tokenizer.get_vocab(with_added_tokens=True)
        size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of every id: a character stands for a byte
        size[list(vocab.values())] = [len(t) for t in vocab]

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Pieces of a space and what follows it are encoded in one string: the next space ends each of them.
            join = [p[0] == 32 and len(p) > 1 and p.count(b" ") == 1 and not ODD.intersection(p) for p in pieces]
            order = [k for k, j in enumerate(join) if j] + [k for k, j in enumerate(join) if not j]
            n = sum(join)
            texts = [b"".join(pieces[k] for k in order[i : min(i + 256, n)]).decode() for i in range(0, n, 256)] + [pieces[k].decode() for k in order[n:]]
            found = [np.zeros(0, np.int32)]
            for k in range(0, len(texts), 1000):
                found += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]
            ids = np.concatenate(found)
            # The ids' bytes tell where a piece ends.
            stop = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(pieces[k]) for k in order])) + 1
            start = np.concatenate(([0], stop[:-1]))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            count = (stop - start)[back]
            return ids[W.ragged(start[back], count)], count

        _workers[path] = Pieces(encode)
    return _workers[path]


def _encode(encoder: Callable[[], Pieces], width: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        pieces = encoder()
        for batch in batches:
            data_all, off = W.utf8(batch.column("text"))
            for i, j in W.chunks(off):
                flat, n = pieces.rows(data_all[off[i] : off[j]], off[i : j + 1] - off[i])
                data = np.insert(flat, np.cumsum(n), END_ID).astype(width)
                stop = np.cumsum(n + 1)
                raw = [data[a:b].tobytes() for a, b in zip(np.concatenate(([0], stop[:-1])), stop, strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(n + 1, pa.int32()), pa.array(raw, pa.binary())], schema=schema)

    return rows, "doc_id long, n int, ids binary"


def _count(vocabulary: int, width: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            cuts = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
            for i, j in W.chunks(cuts, 1 << 19):
                total += np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(i, j - i).to_pylist()), width), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.record_batch([ids.astype(np.int32), total[ids]], names=["id", "n"])

    return rows, "id int, n long"


def _pack(lengths: np.ndarray, bounds: np.ndarray, width: str):
    names = ["part", "doc_id", "n", "packed", "points"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(lengths)
        for batch in batches:
            n_all = batch.column("n").to_numpy()
            cuts = np.concatenate(([0], np.cumsum(n_all)))
            doc = batch.column("doc_id")
            part = np.searchsorted(bounds, doc.fill_null(-(2**63)).to_numpy(), side="right")
            for i, j in W.chunks(cuts, 1 << 19):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(i, j - i).to_pylist()), width).astype(np.int64)
                data, n_bytes, points = code.pack(ids, n_all[i:j].astype(np.int64))
                a = np.concatenate(([0], np.cumsum(n_bytes)))
                p = np.concatenate(([0], np.cumsum((n_all[i:j] + huffman.EVERY - 1) // huffman.EVERY)))
                yield pa.record_batch([
                    pa.array(part[i:j], pa.int32()), doc.slice(i, j - i), pa.array(n_all[i:j], pa.int32()),
                    pa.array([data[x:y].tobytes() for x, y in zip(a[:-1], a[1:], strict=True)], pa.binary()),
                    pa.array([points[x:y].tobytes() for x, y in zip(p[:-1], p[1:], strict=True)], pa.binary()),
                ], names=names)

    return rows, "part int, doc_id long, n int, packed binary, points binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that arrive by part and doc_id."""
    fields = [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("bytes", pa.list_(pa.int32())), ("packed", pa.binary()), ("points", pa.binary())]
    schema = pa.schema(fields)
    part, block, first, held, docs = -1, 0, 0, 0, []

    def close() -> pa.RecordBatch:
        ids, n, packed, points = zip(*docs, strict=True)
        return pa.record_batch([[part], [block], [first], [list(ids)], [list(n)], [[len(x) for x in packed]], [b"".join(packed)], [b"".join(points)]], schema=schema)

    for batch in batches:
        for p, d, n, packed, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs and (p != part or held >= BLOCK):
                yield close()
                block, first, docs, held = block + 1, first + held, [], 0
            if p != part:
                part, block, first = p, 0, 0
            docs.append((d, n, packed, points))
            held += n
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], Pieces], vocabulary: int, limit: int = huffman.LIMIT) -> None:
    """Encode all texts, an end id after each, and write them in ascending doc_id order.

    Null text is the empty text; a null doc_id comes first; rows of one doc_id come by their ids.
    An empty table gives empty files; other columns are ignored. Only the counts of the vocabulary's ids, and
    bounds and totals of parts, reach the driver.
    """
    spark = docs.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    fn, schema = _encode(encoder, width)
    ids = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, schema), "ids")
    counts = np.zeros(vocabulary, np.int64)
    fn, schema = _count(vocabulary, width)
    for r in ids.select("n", "ids").mapInArrow(fn, schema).groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = huffman.code_lengths(counts, limit)
    parts = min(MOST_PARTS, max(1, int(counts.sum()) // PART))
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        at = [k / parts for k in range(1, parts)]
        bounds = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * parts))).first()[0] or [], np.int64))
    fn, schema = _pack(lengths, bounds, width)
    packed = ids.mapInArrow(fn, schema).repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "packed")
    ddl = "part int, block int, first long, doc_ids array<long>, n array<int>, bytes array<int>, packed binary, points binary"
    packed.mapInArrow(_blocks, ddl).write.option("compression", "none").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    starts = np.concatenate(([0], np.cumsum([r.n for r in sizes])))
    spark.createDataFrame([(r.part, int(s)) for r, s in zip(sizes, starts, strict=False)], "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def _decode(lengths: np.ndarray, with_ids: bool):
    names = ["part", "doc_id", "first", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(lengths)
        for batch in batches:
            for k in range(len(batch)):
                part, first, doc, n, size, packed, points = (batch.column(c)[k] for c in ("part", "first", "doc_ids", "n", "bytes", "packed", "points"))
                n, size = n.values.to_numpy().astype(np.int64), size.values.to_numpy().astype(np.int64)
                lanes = (n + huffman.EVERY - 1) // huffman.EVERY
                start = np.frombuffer(points.as_py(), "<i4") + np.repeat((np.cumsum(size) - size) * 8, lanes)
                each = np.minimum(huffman.EVERY, np.repeat(n, lanes) - W.ragged(np.zeros(len(n), np.int64), lanes) * huffman.EVERY)
                ids = code.unpack(np.frombuffer(packed.as_py(), np.uint8), start, each).astype("<u4")
                stop = np.cumsum(n)
                docs = [ids[a:b] for a, b in zip(stop - n, stop, strict=True)]
                out = [pa.array(np.full(len(n), part.as_py()), pa.int32()), doc.values, pa.array(first.as_py() + stop - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64())]
                yield pa.record_batch(out + [pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64()))] * with_ids, names=names)

    return rows, "part int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r.id for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.length
    fn, schema = _decode(lengths, with_ids)
    parts = spark.read.parquet(f"{path}/parts")
    found = spark.read.parquet(f"{path}/blocks").mapInArrow(fn, schema)
    return found.join(parts, "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
