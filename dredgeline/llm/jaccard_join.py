"""N-gram Jaccard self-join: size-aware heavy-light, exact at its threshold.

A document's set holds its distinct ``n``-word shingles (64-bit hashes). Documents with equal sets
form a class with one representative; only representatives are joined.

Order: a fixed-size sketch of shingle frequencies over all documents puts common shingles last.
Correctness needs only that all sets are sorted alike. Two sets that link share at least ``j`` of
the first ``size/10 + j`` shingles of either (for a threshold of 0.9).

Light sets, up to a boundary size, enumerate all pairs (subsets of fixed size two) of that prefix
with j = 2: few keys while sets are small, and very selective. Heavy sets post every shingle of the
prefix with j = 1 to inverted lists that are scanned. Light sets just below the boundary, which may
link to heavy ones, do both. The boundary is chosen by cost: keys that light sets would
write against entries that lists would have scanned, summed by set size over the whole corpus.

Links inside a list: first every member is checked against the list's smallest member. What is
linked by then is one component, and only members of different components are paired further, so a
group of many near copies never makes all its pairs. Pairs are cut by size, by position in the
prefix and by a parity sketch of the whole sets (512 bins; bins of different parity each prove a
shingle that only one set has), then checked exactly on the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from dredgeline.llm import words as W
from dredgeline.llm.components import components
from dredgeline.llm.store import scratch

#: The contract of op10_ngram_jaccard; the pipeline's stage takes 5 and 80.
N, PERCENT = 3, 90
#: Cost of scanning an entry of a list, in keys written and shuffled.
SCAN = 1 / 8
#: Words of 64 bits in a set's parity sketch.
PARITY = 8
#: Keys of a set, the first in the common order, that a pair's first shared list is looked up in.
FIRST = 64
#: Cells of the frequency sketch, in groups of SLAB that are added up together.
CELLS, SLAB = 1 << 20, 1 << 12
LAST = 2**63 - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a text of fewer words is one shingle of all of them."""
    first, end, row = W.spans(data, offsets)
    h = W.hashes(data, first, end, seed=n)
    run = W.runs(h, n)
    out = []
    for a, b in zip(row[:-1], row[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        else:
            x = h[a:b][:1]
            for k in range(a + 1, b):
                x = W.fold(x, h[k : k + 1])
            out.append(x ^ np.uint64(b - a) if b > a else x)
    return out


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, off = W.utf8(batch.column("text"))
    for i, j in W.chunks(off):
        yield i, j, shingles(W.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], n)


def _describe(n: int):
    names = ["did", "th", "size", "fp"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _sets(batch, n):
                fp = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                yield pa.record_batch([batch.column("did").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64())], names=names)

    return rows, "did long, th long, size long, fp long"


def _sketch(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, sets in _sets(batch, n):
                total += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        yield pa.record_batch([pa.array(range(CELLS // SLAB), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, SLAB)], pa.binary())], names=["slab", "n"])

    return rows, "slab int, n binary"


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SLAB, np.int64)
    for x in table.column("n"):
        total += np.frombuffer(x.as_py(), np.uint32 if len(x.as_py()) == 4 * SLAB else np.int64)
    return pa.table({"slab": table.column("slab").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def frequency_levels(keyed: DataFrame, n: int) -> np.ndarray:
    """Per cell of the sketch: 0 for the common run of counts, else the bit length of the excess. CELLS bytes, whatever the corpus."""
    parts = keyed.select("text").mapInArrow(*_sketch(n)).withColumn("some", F.spark_partition_id() % 32)
    # In two steps, so that no group holds the counts of more than a part of the tasks.
    parts = parts.groupBy("slab", "some").applyInArrow(_add, "slab int, n binary").groupBy("slab").applyInArrow(_add, "slab int, n binary")
    total = np.zeros((CELLS // SLAB, SLAB), np.int64)
    for r in parts.toLocalIterator():
        total[r.slab] = np.frombuffer(r.n, np.int64)
    total = total.ravel()
    usual = np.median(total)
    over = np.maximum(total - usual - 6 * np.sqrt(usual + 1), 0)
    return np.ceil(np.log2(over + 1)).astype(np.uint8)


def slack(size: int | np.ndarray | Column, percent: int) -> Column | int | np.ndarray:
    """Shingles that a set may lose and still link."""
    return size * (100 - percent) // 100 if not isinstance(size, Column) else F.floor(size * (100 - percent) / 100).cast("int")


def _prefix(n: int, percent: int, levels):
    names = ["did", "th", "size", "prefix", "scanned", *(f"p{k}" for k in range(PARITY))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            did, th = batch.column("did"), batch.column("th")
            for i, j, sets in _sets(batch, n):
                keep, cost, parity = [], [], np.zeros((len(sets), PARITY), np.int64)
                for k, s in enumerate(sets):
                    odd = np.bincount((s >> np.uint64(21) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                    parity[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    lv = level[(s % np.uint64(CELLS)).astype(np.int64)]
                    p = s[np.lexsort((s, lv))[: slack(len(s), percent) + 2]]
                    keep.append(p.tobytes())
                    # Entries that the lists of this prefix are expected to hold beside the set's own.
                    cost.append(float((np.exp2(np.sort(lv)[: len(p)].astype(np.float64)) - 1).sum()))
                yield pa.record_batch([did.slice(i, j - i), th.slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()), pa.array(keep, pa.binary()), pa.array(cost, pa.float64()), *(pa.array(np.ascontiguousarray(x)) for x in parity.T)], names=names)

    return rows, "did long, th long, size int, prefix binary, scanned double, " + ", ".join(f"p{k} long" for k in range(PARITY))


def boundary(prefixes: DataFrame, percent: int) -> int:
    """Largest size of a light set: the cut with the least total of subset keys below and list keys and entries above.

    The sketch counts documents; the copies in a set's own class stand in no list and are taken off.
    """
    p = slack(F.col("size"), percent)
    by = prefixes.groupBy(F.floor(F.log2("size") * 4).alias("band")).agg(
        F.max("size").alias("top"), F.sum((p + 2) * (p + 1) / 2).alias("light"), F.sum(p + 1 + SCAN * F.greatest(F.lit(0.0), F.col("scanned") - (p + 2) * (F.col("copies") - 1))).alias("heavy")
    ).orderBy("band").collect()  # a few bands per power of two
    cost = [sum(r.light for r in by[:k]) + sum(r.heavy for r in by[k:]) for k in range(len(by) + 1)]
    k = max(range(len(cost)), key=lambda k: (-cost[k], k))  # of equals the larger
    return by[k - 1].top if k else 0


def _postings(percent: int, light: int):
    names = ["key", "fp", "size", "pos"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            fp = batch.column("fp").to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for k, raw in enumerate(batch.column("prefix")):
                s = np.frombuffer(raw.as_py(), np.uint64)
                found = []
                if size[k] <= light and len(s) > 1:
                    a, b = np.triu_indices(len(s), 1)
                    found.append((W.fold(W.mix(s[a]), s[b]), a))
                if 100 * int(size[k]) >= percent * (light + 1):  # above the boundary, or able to link to what is
                    found.append((s[: slack(int(size[k]), percent) + 1], np.arange(slack(int(size[k]), percent) + 1)))
                for key, pos in found:
                    for col, v in zip(out, (key.view(np.int64), np.full(len(key), fp[k]), np.full(len(key), size[k], np.int32), pos.astype(np.int32)), strict=True):
                        col.append(v)
                    held += len(key)
                if held > 1 << 18 or k == len(batch) - 1:
                    if held:
                        yield pa.record_batch([np.concatenate(c) for c in out], names=names)
                    out, held = [[], [], [], []], 0

    return rows, "key long, fp long, size int, pos int"


def _check(n: int, percent: int):
    names = ["a", "b", "linked"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("a", "b")]
            texts = [W.utf8(batch.column(c)) for c in ("text_a", "text_b")]
            linked = []
            for i, j in W.chunks(texts[0][1] + texts[1][1]):
                sides = []
                for own, (data, off) in zip(ids, texts, strict=True):
                    # A text stands in many pairs: each is cut once a chunk, all in one go.
                    _, one, back = np.unique(own[i:j], return_index=True, return_inverse=True)
                    parts = [data[off[i + k] : off[i + k + 1]] for k in one]
                    sets = shingles(W.LOWER[np.concatenate(parts)], np.concatenate(([0], np.cumsum([len(p) for p in parts]))), n)
                    sides.append((sets, back))
                for k in range(j - i):
                    x, y = (sets[back[k]] for sets, back in sides)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=names)

    return rows, "a long, b long, linked boolean"


def _may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and positions allow, for the first shared shingle of a pair."""
    sa, sb, pa_, pb = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    common = F.least(sa - pa_, sb - pb)
    return (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)) & ((100 + percent) * common >= percent * (sa + sb))


def _parities_agree(a: str, b: str, percent: int) -> Column:
    """False only for sets that cannot link: bins of different parity hold at least one shingle of one set alone."""
    apart = sum(F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(PARITY))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def linked_classes(docs: DataFrame, n: int = N, percent: int = PERCENT, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with did, th, size and fp; links (a, b) between classes; classes (fp, component label, did)).

    The links are those that make the components, not all there are: sets already in one component
    are not compared again. With ``every`` all pairs that lists hold are compared and no link between
    classes is missing, at the price of all pairs inside a group of near copies.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), F.col("text"))
    described = scratch(keyed.mapInArrow(*_describe(n)), "sets")
    classes = described.where("size > 0").groupBy("fp").agg(F.min(F.struct("did", "th")).alias("r"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies")).select("fp", "r.did", "r.th", "size", "copies")
    classes = scratch(classes, "classes")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(keyed, n))
    # The text passes once more, now sorted by the common order; a copy's prefix is dropped by the join.
    least = -(-percent // (100 - percent))  # smaller sets link to equal ones only
    fn, schema = _prefix(n, percent, levels)
    prefixes = keyed.mapInArrow(fn, schema).where(F.col("size") >= least)
    prefixes = scratch(prefixes.join(classes.drop("size"), ["did", "th"]).dropDuplicates(["fp"]), "prefixes")
    light = boundary(prefixes, percent)
    fn, schema = _postings(percent, light)
    entries = prefixes.select("fp", "size", "prefix").mapInArrow(fn, schema)
    # Lists of one set go; what is left is stored, with the list's smallest member.
    shared = entries.groupBy("key").agg(F.min(F.struct("fp", "size", "pos")).alias("head"), F.max("fp").alias("most")).where("head.fp < most").select("key", "head")
    lists = scratch(entries.join(shared, "key"), "lists")
    # The texts move once, to be stored for the sets that any list holds.
    wanted = lists.select("fp").distinct().join(classes, "fp").select("fp", "did", "th")
    texts = scratch(keyed.join(wanted, ["did", "th"]).dropDuplicates(["did", "th"]).select("fp", "text"), "set-texts")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        side = [texts.select(F.col("fp").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b")]
        fn, schema = _check(n, percent)
        return scratch(scratch(pairs, f"{name}-pairs").join(side[0], "a").join(side[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(fn, schema), name)

    l, h = "l", "h"
    star = lists.select(F.struct("fp", "size", "pos").alias(l), F.col("head").alias(h)).where((F.col("l.fp") > F.col("h.fp")) & _may_link(l, h, percent))
    first = verify(star.select(F.col("h.fp").alias("a"), F.col("l.fp").alias("b")).distinct(), "star")
    label = components(first.where("linked").select("a", "b"))
    # Pairs of different components in one list that were not checked yet.
    label = scratch(label.select(F.col("node").alias("fp"), "label"), "labels")
    labelled = lists.select("key", "fp", "size", "pos").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    if every:
        labelled = labelled.withColumn("label", F.col("fp"))
    several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    # A pair stands in all lists that both are in. It is made where none of the first keys, in the order that all sets share, comes earlier in both.
    order = Win.partitionBy("fp").orderBy("pos", "key")
    member = labelled.join(several, "key").withColumn("first", F.when(F.row_number().over(order) <= FIRST, F.col("key")))
    member = member.withColumn("earlier", F.collect_list("first").over(order.rowsBetween(Win.unboundedPreceding, -1))).drop("first")
    member = scratch(member.join(prefixes.select("fp", *(f"p{k}" for k in range(PARITY))), "fp"), "members")
    x = member.where((2 * percent) * F.col("size") <= (100 + percent) * (F.col("size") - F.col("pos"))).alias("x")  # the smaller of a pair needs no more of its prefix
    y = member.alias("y")
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.fp") < F.col("y.fp")))
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & order & _may_link("x", "y", percent) & _parities_agree("x", "y", percent) & ~F.arrays_overlap("x.earlier", "y.earlier"))
    cross = cross.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = verify(cross, "cross")
    links = first.unionAll(second).where("linked").select("a", "b")
    label = components(links)
    named = classes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "did", F.col("th").alias("rep_th"))
    return described, links, named


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and representative.

    component_id is the smallest doc_id that links of ``percent`` or more reach, the document's own
    included; representative is true for one row of each component. Documents without words (or
    with null text) have no shingles and are components of their own. A null doc_id counts as the
    largest and is returned as null. Rows with equal sets are linked; a repeated row is a row of its
    own. An empty table gives an empty table; other columns are ignored.
    """
    described, _, named = linked_classes(docs, n, percent)
    least = named.groupBy("label").agg(F.min("did").alias("component"))
    of = named.join(least, "label").select("fp", "component")
    out = described.join(of, "fp", "left").withColumn("component", F.coalesce("component", "did"))
    return out.select(F.nullif("did", F.lit(LAST)).alias("doc_id"), "th", F.col("size").alias("n_shingles"), F.nullif("component", F.lit(LAST)).alias("component_id"))


def link_counts(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_links): with how many other rows of ``docs`` each one is linked, its equals included."""
    described, links, _ = linked_classes(docs, n, percent, every=True)
    rows = described.where("size > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("rows"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(rows, F.col("b") == F.col("fp")).groupBy("a").agg(F.sum("rows").alias("beyond"))
    per_class = rows.join(beyond, F.col("fp") == F.col("a"), "left").select("fp", (F.col("rows") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    out = described.join(per_class, "fp", "left")
    return out.select(F.nullif("did", F.lit(LAST)).alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("n_links")).otherwise(0).alias("n_links"))


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of every component; rows without words all stay.

    It is a row with the smallest doc_id (null is the largest); of several rows with that id the one
    with the least hash of its text, then the least hash of the whole row. All columns stay,
    whatever their names.
    """
    described, _, named = linked_classes(docs, n, percent)
    best = named.groupBy("label").agg(F.min(F.struct("did", "rep_th")).alias("best"))
    of = named.join(best, "label").select("fp", "best")
    fate = described.where("size > 0").groupBy("did", "th", "fp").agg(F.count(F.lit(1)).alias("rows")).join(of, "fp")
    lost = F.struct("did", F.col("th").alias("rep_th")) != F.col("best")
    # Only rows that go, or that have an equal row, need to meet the texts.
    fate = fate.select(F.col("did").alias("fate_did"), F.col("th").alias("fate_th"), lost.alias("lost"), "rows").where("lost OR rows > 1")
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = packed.join(fate, (F.col("did") == F.col("fate_did")) & (F.col("th") == F.col("fate_th")), "left").where("lost IS NULL OR NOT lost")
    place = F.row_number().over(Win.partitionBy("did", "th").orderBy(F.xxhash64("row"), F.to_json("row")))
    return kept.withColumn("place", F.when(F.col("rows").isNull(), 1).otherwise(place)).where("place = 1").select("row.*")
