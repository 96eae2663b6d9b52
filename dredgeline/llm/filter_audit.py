"""Interaction of corpus filters: what each one removes in every order, and its Shapley share.

A document is a set of failed filters. Within a part all that matters is how many documents have
each set, so the corpus is counted once into at most 2**m cells a part, and everything else is done
on the lattice of applied filters: a state is the set of filters that ran, an edge runs one more.
A document leaves on the first edge whose filter it fails, so the removals of an edge depend on its
two ends alone, never on the order in which the start was reached.

Paths are counted forwards from the empty state (orders that reach a state) and backwards from the
full one (orders that finish it). An edge lies on forward * backward orders; its removals times that
number, added up over the edges of one filter, are the filter's removals over all orders, m! times
its Shapley value. The steps of a single order are read from the edges that its path takes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: All orders are listed, so there are few filters: 5,040 orders at seven.
MOST_FILTERS = 7
#: Groups that rows without doc_id are dealt to in the join with labels, which they cannot match.
SALTS = 1024
SPACE = r"[\x20\x09-\x0D]+"


def _n_and_distinct(text: Column) -> Column:
    """Words and distinct words of a text that is split once."""
    words = F.array_remove(F.split(text, SPACE), "")
    return F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))


#: Failure conditions on (text, word counts). E compares texts and is found over the whole table.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, w: w["n"] < 200,
    "B": lambda text, w: 100 * w["distinct"] < 50 * w["n"],
    "C": lambda text, w: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text),
    "D": lambda text, w: text.rlike(r"[#$%&*|]"),
}
REPEAT = "E"


def _bits(letters: str) -> dict[str, int]:
    if not 0 < len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters with different letters")
    return {x: 1 << i for i, x in enumerate(letters)}


def failure_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, repeat: str = REPEAT) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail, bit i for the i-th letter.

    ``repeat`` is the letter of the filter that fails a text which a smaller doc_id has, anywhere in
    the table. Null text is empty, a null source is the part ''. A null doc_id is larger than all others
    and has no label; rows that repeat a doc_id and its text do not fail each other. Of several
    labels of a document one that says 1 counts. An empty table gives no cells.
    """
    bit = _bits("".join(filters) + repeat)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("did"), F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), _n_and_distinct(text).alias("w"), F.unhex(F.sha2(text, 256)).alias("same"),
    )
    # The heavy counts are a column of their own project: an alias that several filters read is not computed anew for each.
    failed = reduce(lambda a, b: a.bitwiseOR(b), (F.when(fails(F.col("t"), F.col("w")), bit[x]).otherwise(0) for x, fails in filters.items()))
    own = own.select("did", "part", "same", failed.alias("mask"), F.when(F.col("did").isNull(), F.pmod(F.xxhash64("same"), F.lit(SALTS)) + 1).otherwise(0).alias("salt"))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("did")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).withColumn("salt", F.lit(0).cast("long"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = own.join(marked, ["did", "salt"], "left").select("did", "salt", "part", "same", "mask", *flags)
    # Rows of one document first, then, after partial aggregates, the rows of one text: a text with very many copies meets as one row a task.
    rows = rows.groupBy("did", "salt", "part", "same", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    key = ["same", "part", "mask", "good", "toxic"]
    last = F.coalesce("did", F.lit(2**63 - 1))
    texts = rows.groupBy(key).agg(F.min(F.struct(last.alias("did"), "n")).alias("first"), F.sum("n").alias("n"))
    # A window, so that the texts are read once: a group has a row for each part and set of flags, however many copies there are.
    texts = texts.withColumn("least", F.min("first.did").over(Win.partitionBy("same"))).withColumn("kept", F.when(F.col("first.did") == F.col("least"), F.col("first.n")).otherwise(0))
    # A null doc_id never is the smaller one of two: rows without it stand side by side.
    texts = texts.withColumn("kept", F.when(F.col("least") == 2**63 - 1, F.col("n")).otherwise(F.col("kept")))
    both = F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit[repeat])).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    cells = texts.select("part", "good", "toxic", both.alias("c")).where("c.n > 0")
    counted = [F.sum(F.when(F.col(x), F.col("c.n")).otherwise(0)).alias(x) for x in ("good", "toxic")]
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), *counted)


def lattice(letters: str) -> list[tuple[int, int, int]]:
    """(state, filter, paths) for every edge: the orders that take it, by counting paths forwards and backwards."""
    bit, full = _bits(letters), (1 << len(letters)) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(full + 1):  # every subset is a smaller number than its supersets
        for f in bit.values():
            if s & f:
                reach[s] += reach[s ^ f]
    for s in range(full, -1, -1):
        for f in bit.values():
            if not s & f:
                leave[s] += leave[s | f]
    return [(s, f, reach[s] * leave[s | f]) for s in range(full + 1) for f in bit.values() if not s & f]


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as SQL literals: no Python source in the plan."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r)})' for r in rows)} AS t({names})")


def edge_counts(cells: DataFrame, letters: str) -> DataFrame:
    """(part, state, filter, paths, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every edge.

    shapley, the same on all edges of a filter, is what it removes over all orders.
    """
    edges = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(p).cast("long").alias("paths")) for s, f, p in lattice(letters)))
    x = cells.withColumn("e", F.explode(edges)).select("part", "mask", "n", "good", "toxic", "e.*")
    passed, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.col("filter")) != 0

    def total(condition: Column, what: str) -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")

    counts = x.groupBy("part", "state", "filter", "paths").agg(
        total(passed & ~fails, "n").alias("kept"), total(passed & fails, "n").alias("removed"), total(~passed & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("filter"), "n").alias("unique_fails"), total(passed & fails, "good").alias("good_lost"), total(passed & fails, "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Win.partitionBy("part", "filter")))


def audit(cells: DataFrame, letters: str = "".join(FILTERS) + REPEAT) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of every order, zeros included."""
    bit = _bits(letters)
    steps = []
    for order in permutations(letters):
        state = 0
        for k, x in enumerate(order):
            steps.append(("".join(order), k + 1, state, bit[x]))
            state |= bit[x]
    taken = F.broadcast(_values(cells.sparkSession, "filter_order, step, state, filter", steps))  # m! * m rows, whatever the corpus
    return edge_counts(cells, letters).join(taken, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five registered filters over whole texts (see :func:`failure_cells` and :func:`audit`)."""
    return audit(failure_cells(docs, labels))
