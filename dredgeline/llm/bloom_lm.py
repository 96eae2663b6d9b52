"""Language-model scores from a log-frequency Bloom filter.

Counting: a task adds up the hashed words and word pairs of its texts and hands them on as sorted
arrays, one row per hash bucket; a bucket's reducer merges them. Everything is counted, over all
training texts.

Filter: a count c is quantised to 1 + floor(log2 c) levels, and an n-gram goes into the filter once
for every level up to its own. A reader probes level after level until a miss or the highest level of the
segment; false positives can only raise a count, each further level with the filter's error rate once
more. Each bucket has a segment of ``BITS`` bits for each entry, whatever the corpus, so the error rate
stays the same.

Reading: segments of up to ``FILTER_MB`` in all are broadcast. A larger filter stays where it is: texts are
packed into groups of about ``GROUP`` bytes, a group's distinct n-grams go to the segments of their
buckets, and their levels come back to the group as one byte each.

Scores: the pair's count is smoothed towards the word's share, P(w|h) = (c(hw) + mu P(w)) / (c(h) + mu)
with all counts read from the filter. The base score needs exact counts: the ``TOP`` most frequent words are
broadcast, all others are joined.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.llm import words as W
from dredgeline.llm.store import scratch

BITS, FILTER_MB, TOP, MU = 10, 128, 1 << 20, 400.0
#: N-grams meant for a bucket, the fewest buckets, and the characters of text that are taken for one token.
ENTRIES, LEAST_BUCKETS, PER_TOKEN = 1 << 18, 64, 5
#: Largest segment in bits, 1 GB: a binary value of Spark and Arrow holds less than 2 GB.
MOST = 1 << 33
#: Bytes of text in a group.
GROUP = 4 << 20
#: N-grams looked up at once in a segment.
PROBED = 1 << 18
END = np.uint64(0xE0D0E0D0E0D0E0D1)
WORD, PAIR = 0, 1
#: Bits of a key that a segment goes by: five bytes, which a million others in it share with a chance of 1e-6.
INSIDE = np.uint64((1 << 40) - 1)
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1_500_000


def n_buckets(chars: int) -> int:
    """A power of two that gives a bucket about ENTRIES tokens of a text of so many characters."""
    return max(LEAST_BUCKETS, 1 << (chars // PER_TOKEN // ENTRIES).bit_length())


def shift(buckets: int) -> np.uint64:
    """A key's bucket is its leading bits."""
    return np.uint64(64 - buckets.bit_length() + 1)


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """The fold of a document; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every row, an end after each; first token of every row."""
    data = W.LOWER[data]
    first, end, row = W.spans(data, offsets)
    return np.insert(W.hashes(data, first, end), row[1:], END), row + np.arange(len(row))


def pairs(t: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs inside rows, and the place of each pair's second word."""
    second = np.ones(len(t), bool)
    second[row[:-1]] = False
    at = np.flatnonzero(second)
    return W.fold(t[at - 1], t[at]), at


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _count(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {kind: ([], []) for kind in (WORD, PAIR)}

    def flush(kind: int) -> pa.RecordBatch:
        k, c = _sum(*held[kind])
        held[kind] = ([], [])
        cut = np.searchsorted(k >> shift(buckets), np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        small = c.max(initial=0) < 256
        c = c.astype(np.uint8 if small else np.int64)
        return pa.record_batch([
            pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()),
            pa.array([k[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([c[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
        ], names=["kind", "bucket", "keys", "counts"])

    for batch in batches:
        data, off = W.utf8(batch.column("text"))
        for i, j in W.chunks(off):
            t, row = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for kind, g in ((WORD, t), (PAIR, pairs(t, row)[0])):
                k, c = np.unique(g, return_counts=True)
                held[kind][0].append(k)
                held[kind][1].append(c)
                if sum(map(len, held[kind][0])) > HELD:
                    yield flush(kind)
    for kind in (WORD, PAIR):
        if held[kind][0]:
            yield flush(kind)


def level(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def _places(keys: np.ndarray, lv: int, bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    h = W.mix((keys & INSIDE) + np.array([lv], np.uint64) * W.K2)
    step = W.mix(h ^ W.K1) | np.uint64(1)
    for _ in range(probes):
        yield (h % bits).astype(np.int64)
        h = h + step


def _build(bits_each: int, most: int, probes: int):
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("distinct", pa.int64()), ("total", pa.int64()), ("entries", pa.int64()), ("top", pa.int64()), ("segment", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def segment(group: pa.Table) -> pa.Table:
        ks, cs = [], []
        for k, c in zip(group.column("keys"), group.column("counts"), strict=True):
            ks.append(np.frombuffer(k.as_py(), np.uint64))
            raw = c.as_py()
            cs.append(np.frombuffer(raw, np.uint8 if len(raw) == len(ks[-1]) else np.int64).astype(np.int64))
        k, c = _sum(ks, cs)
        lv = level(c)
        size = max(8, -(-bits_each * int(lv.sum()) // 8))
        if size * 8 > most:
            raise ValueError(f"a segment of {size} bytes: more buckets are needed")
        seg = np.zeros(size, np.uint8)
        for j in range(1, int(lv.max(initial=0)) + 1):
            for at in _places(k[lv >= j], j, np.uint64(size * 8), probes):
                np.bitwise_or.at(seg, at >> 3, (1 << (at & 7)).astype(np.uint8))
        kind = group.column("kind")[0].as_py()
        word = kind == WORD
        return pa.table([[kind], [group.column("bucket")[0].as_py()], [len(k)], [int(c.sum())], [int(lv.sum())], [int(lv.max(initial=0))], [seg.tobytes()], [k.tobytes() if word else b""], [c.tobytes() if word else b""]], schema=schema)

    return segment, "kind int, bucket int, distinct long, total long, entries long, top long, segment binary, keys binary, counts binary"


class Filter:
    """Quantised counts of both orders; picklable."""

    def __init__(self, probes: int, buckets: int) -> None:
        self.probes, self.buckets = probes, buckets
        self.bits = np.full(2 * buckets, 1, np.uint64)
        self.start = np.full(2 * buckets, -1, np.int64)
        self.top = np.zeros(2 * buckets, np.int64)
        self.data = np.zeros(0, np.uint8)

    def fill(self, segments: Iterator) -> "Filter":
        parts, at = [], 0
        for r in segments:
            slot = r.kind * self.buckets + r.bucket
            self.bits[slot], self.start[slot], self.top[slot] = len(r.segment) * 8, at, r.top
            parts.append(r.segment)
            at += len(r.segment)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        return self

    def counts(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Expected count of each n-gram, 0 if its first level misses."""
        return expected(self.levels(keys, kind))

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        slot = (keys >> shift(self.buckets)).astype(np.int64) + kind * self.buckets
        lv = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.start[slot] >= 0)
        j = 1
        while len(live):
            start, there = self.start[slot[live]], np.arange(len(live))
            for at in _places_of(keys[live], j, self.bits[slot[live]], self.probes):
                place = at(there)
                there = there[(self.data[start[there] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
            live = live[there]
            lv[live] = j
            j += 1
            live = live[self.top[slot[live]] >= j]
        return lv


def expected(lv: np.ndarray) -> np.ndarray:
    lv = lv.astype(np.float64)
    return np.where(lv > 0, (np.exp2(lv - 1) + np.exp2(lv) - 1) / 2, 0.0)


def _places_of(keys: np.ndarray, lv: int, bits: np.ndarray, probes: int):
    """As :func:`_places`, each probe only for the keys that are left."""
    h = W.mix((keys & INSIDE) + np.array([lv], np.uint64) * W.K2)
    step = W.mix(h ^ W.K1) | np.uint64(1)
    for i in range(probes):
        yield lambda k, i=np.uint64(i): ((h[k] + i * step[k]) % bits[k]).astype(np.int64)


def _scorer(keys: np.ndarray, exact: np.ndarray, total: int, distinct: int, mu: float):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"]
    rest_type = pa.struct([("h", pa.int64()), ("n", pa.int32())])
    table, below = W.Lookup(keys), total + 0.5 * (distinct + 1)

    def score(doc_id, held, data: np.ndarray, off: np.ndarray, counts) -> pa.RecordBatch:
        """Scores of the texts in ``data``; ``counts`` reads the filter for sorted distinct n-grams of a kind."""
        t, row = tokens(data, off)
        doc = np.repeat(np.arange(len(row) - 1), np.diff(row))
        k, back = np.unique(t, return_inverse=True)
        at = table.find(k)
        found = at >= 0
        base = np.where(found, np.log10((np.where(found, exact[at], 0) + 0.5) / below), 0.0)
        word = counts(k, WORD)
        share = (word + 0.5) / below
        g, second = pairs(t, row)
        gk, gback = np.unique(g, return_inverse=True)
        pair = counts(gk, PAIR)[gback]
        p = share[back]
        before = word[back[second - 1]]
        p[second] = (np.minimum(pair, before) + mu * p[second]) / (before + mu)
        n = len(row) - 1
        # Words beyond the broadcast table, per document.
        left = np.flatnonzero(~found[back])
        pos, times = np.unique(doc[left] * np.int64(len(k)) + back[left], return_counts=True)
        each = np.bincount(pos // max(1, len(k)), minlength=n)
        rest = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(each))).astype(np.int32), pa.StructArray.from_arrays([k[pos % max(1, len(k))].view(np.int64), pa.array(times, pa.int32())], fields=list(rest_type)))
        return pa.record_batch([
            doc_id, held, np.diff(row), np.bincount(doc, found[back], n).astype(np.int64),
            np.bincount(doc, base[back], n), np.bincount(doc, np.log10(p), n), rest,
        ], names=names)

    return score


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<h:long,n:int>>"


def _score(model, top, total: int, distinct: int, mu: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, lm = _scorer(*top.value, total, distinct, mu), model.value
        for batch in batches:
            data, off = W.utf8(batch.column("text"))
            for i, j in W.chunks(off):
                yield score(batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], lm.counts)

    return rows, SCORED


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a group of texts; its number is the partition's and its place in that."""
    from pyspark import TaskContext

    grp = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, off = W.utf8(batch.column("text"))
        for i, j in W.chunks(off, GROUP):
            part = batch.slice(i, j - i)
            yield pa.record_batch([pa.array([grp], pa.int64()), *(pa.array([part.column(c).to_pylist()], t) for c, t in (("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())))),
                                   pa.array([(off[i : j + 1] - off[i]).tolist()], pa.list_(pa.int64())), pa.array([pa.compress(data[off[i] : off[j]].tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["grp", "ids", "held", "off", "data"])
            grp += 1


def _text(data: pa.Scalar, off: np.ndarray) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.as_py(), int(off[-1]), codec="zstd", asbytes=True), np.uint8) if off[-1] else np.zeros(0, np.uint8)


def _ask(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, off, data in zip(batch.column("grp"), batch.column("off"), batch.column("data"), strict=True):
            off = off.values.to_numpy()
            t, row = tokens(_text(data, off), off)
            for kind, g in ((WORD, t), (PAIR, pairs(t, row)[0])):
                k = np.unique(g)
                cut = np.searchsorted(k >> shift(buckets), np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cut))
                k = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # INSIDE
                yield pa.record_batch([pa.array(np.full(len(some), grp.as_py()), pa.int64()), pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()), pa.array([k[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())], names=["grp", "kind", "bucket", "asked"])


def _answer(probes: int, buckets: int):
    schema = pa.schema([("grp", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("levels", pa.binary())])

    def levels(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not len(asked):
            return schema.empty_table()
        kind, bucket = (asked.column(c)[0].as_py() for c in ("kind", "bucket"))
        # The segment is the only one here: it takes the place of bucket 0 of a filter of one bucket.
        lm = Filter(probes, 1).fill(Segment(r["kind"], 0, r["top"], r["segment"]) for r in segment.select(Segment._fields).to_pylist())
        asks = [k.as_py() for k in asked.column("asked")]
        raw = np.frombuffer(b"".join(asks), np.uint8).reshape(-1, 5)
        lv = np.zeros(len(raw), np.uint8)
        for i in range(0, len(raw), PROBED):
            k = np.zeros((len(raw[i : i + PROBED]), 8), np.uint8)
            k[:, :5] = raw[i : i + PROBED]
            lv[i : i + PROBED] = lm.levels(k.view("<u8").ravel(), kind)
        end = np.cumsum([len(x) // 5 for x in asks])
        found = [lv[e - len(x) // 5 : e].tobytes() for e, x in zip(end, asks, strict=True)]
        return pa.table([asked.column("grp"), asked.column("kind"), asked.column("bucket"), pa.array(found, pa.binary())], schema=schema)

    return levels, "grp long, kind int, bucket int, levels binary"


Segment = namedtuple("Segment", "kind bucket top segment")


def _score_group(top, total: int, distinct: int, mu: float):
    def scores(group: pa.Table, answers: pa.Table) -> pa.Table:
        score = _scorer(*top.value, total, distinct, mu)
        # Buckets are the leading bits of a key: in their order, levels stand as sorted distinct keys do.
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "levels")), strict=True))
        by = {kind: expected(np.frombuffer(b"".join(x for k, _, x in got if k == kind), np.uint8)) for kind in (WORD, PAIR)}
        one = group.select(["ids", "held", "off", "data"]).slice(0, 1)
        ids, held, off, data = (one.column(c)[0] for c in one.column_names)
        return pa.Table.from_batches([score(ids.values, held.values, _text(data, off.values.to_numpy()), off.values.to_numpy(), lambda _, kind: by[kind])])

    return scores, SCORED


def score_by_join(rows: DataFrame, segments: DataFrame, top, probes: int, buckets: int, total: int, distinct: int, mu: float) -> DataFrame:
    """As a broadcast of the filter would score ``rows``, with each n-gram sent to its segment.

    A bucket meets its segment in one task: some ENTRIES entries, and what the groups ask of it, which
    is as much again for rare n-grams and five bytes a group for each common one.
    """
    groups = scratch(rows.mapInArrow(_pack, "grp long, ids array<long>, held array<boolean>, off array<long>, data binary"), "lm-groups")
    asked = groups.select("grp", "off", "data").mapInArrow(partial(_ask, buckets), "grp long, kind int, bucket int, asked binary")
    key = ["kind", "bucket"]
    fn, ddl = _answer(probes, buckets)
    answers = asked.groupBy(key).cogroup(segments.select(*Segment._fields).groupBy(key)).applyInArrow(fn, ddl)
    fn, ddl = _score_group(top, total, distinct, mu)
    return groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(fn, ddl)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, c in zip(batch.column("keys"), batch.column("counts"), strict=True):
            yield pa.record_batch([np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)], names=["h", "c"])


def score_texts(docs: DataFrame, held: Column | None = None, mu: float = MU, filter_mb: int = FILTER_MB, top: int = TOP, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the rows that ``held`` does not mark. Null text is the empty text: one end token. A
    repeated row counts each time and is scored each time; a null doc_id stays null. With no
    training row every count is 0. An empty table gives an empty table; other columns are ignored.
    The scores do not depend on ``filter_mb``, the size up to which the filter is broadcast, and with many
    ``bits`` an entry they come from the quantised counts alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (held_out(F.col("doc_id")) if held is None else held).alias("held_out"))
    probes = 4
    training = rows.where(~F.col("held_out"))
    buckets = n_buckets(training.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    counted = training.select("text").mapInArrow(partial(_count, buckets), "kind int, bucket int, keys binary, counts binary")
    segments = scratch(counted.groupBy("kind", "bucket").applyInArrow(*_build(bits, MOST, probes)), "lm-segments")
    total, distinct = segments.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    words = segments.where(F.col("kind") == WORD).select("keys", "counts").mapInArrow(_words, "h long, c long")
    # The smallest count whose words all fit the broadcast table.
    sizes = {r.c: r.n for r in words.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bar, room = (1 << 16) + 1, top
    for c in sorted(sizes, reverse=True):
        room -= sizes[c]
        if room < 0:
            break
        bar = c
    frequent = words.where(F.col("c") >= bar).toArrow()
    known = (frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy())
    top_words = spark.sparkContext.broadcast(known)
    if segments.agg(F.coalesce(F.sum(F.length("segment")), F.lit(0))).first()[0] <= filter_mb << 20:
        model = spark.sparkContext.broadcast(Filter(probes, buckets).fill(segments.select("kind", "bucket", "top", "segment").toLocalIterator()))
        fn, ddl = _score(model, top_words, total, distinct, mu)
        scores = rows.mapInArrow(fn, ddl)
    else:
        scores = score_by_join(rows, segments, top_words, probes, buckets, total, distinct, mu)
    scored = scratch(scores.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.n").join(words.where(F.col("c") < bar), "h", "left")
    below = float(total + 0.5 * (distinct + 1))
    more = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / below)).alias("base")
    )
    zero = F.lit(0)
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score",
    )
