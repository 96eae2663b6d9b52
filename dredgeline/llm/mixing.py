"""Mixing sources to target weights by a hypergeometric splitting tree, in built-in functions only.

Documents fall by a hash into the blocks of their source. An epoch of a source is a permutation of
its blocks; a source draws whole epochs and then the first blocks of the next one until its target
is met, so blocks are drawn without overlap inside an epoch. The last block is cut at a document, and
a few single documents of the source fill what is then missing.

The number of blocks that every source has drawn is its quota. The quotas of the whole mix are the
root of a binary tree; each node hands half of its blocks to either child, the composition being a
multivariate hypergeometric draw (one source after the other), until every leaf is a shard. The
quotas of the shards add up to those of the sources exactly. A source's drawn blocks go to
the shards in their permuted order, and each shard is shuffled for itself.

Only sizes, blocks and quotas are aggregated; texts move once, to their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from dredgeline.llm.quality_rules import bound
from dredgeline.llm.store import scratch

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Fewest and most shards and blocks of a source, and the words meant for one: both grow with the corpus, in powers of two.
SHARDS, MOST_SHARDS, SHARD_WORDS = 16, 1 << 16, 1 << 22
BLOCKS, MOST_BLOCKS, BLOCK_WORDS = 256, 1 << 20, 1 << 18
#: A table of blocks up to this many rows is broadcast.
SMALL = 200_000
#: Single documents that fill up a source's last block.
FILLS = 3
ALL = 2**62


def _number(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _grown(least: int, most: int, words: int, each: int) -> int:
    """A power of two that gives each of so many about ``each`` words."""
    return min(most, max(least, 1 << max(0, -(-words // each) - 1).bit_length()))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the source key (s, no_s), the number that gives its block, and the document's place in the block."""
    h = _hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.withColumns({"__s": F.coalesce("source", F.lit("")), "__no": F.col("source").isNull().cast("int"), "__h": _number(h, 1, 8), "__key": _number(h, 9, 15)})


def _blocked(keyed: DataFrame, blocks: int) -> DataFrame:
    return keyed.withColumn("__block", (F.col("__h") % blocks).cast("int")).drop("__h")


def _log_factorial(n: Column) -> Column:
    x = n + F.lit(8.0)
    product = (n + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * (n + 6) * (n + 7) * (n + 8)
    return x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) - F.log(product)


def _hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws``, by inversion with ``u`` in [0, 1)."""
    mean = good * draws / F.greatest(good + bad, F.lit(1))
    wide = 10 * F.sqrt(F.greatest(mean, F.lit(1.0))) + 10
    lo = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - wide))
    hi = F.least(good, draws, F.ceil(mean + wide))

    def choose(n: Column, k: Column) -> Column:
        return _log_factorial(n.cast("double")) - _log_factorial(k.cast("double")) - _log_factorial((n - k).cast("double"))

    def picked(p: Column) -> Column:
        goal = u * F.aggregate(p, F.lit(0.0), lambda a, x: a + x["p"])
        none = F.lit(None).cast("long")
        return F.coalesce(
            F.aggregate(
                p, F.struct(F.lit(0.0).alias("sum"), none.alias("k")),
                lambda a, x: F.struct((a["sum"] + x["p"]).alias("sum"), F.when(a["k"].isNull() & (a["sum"] + x["p"] > goal), x["k"]).otherwise(a["k"]).alias("k")),
            )["k"],
            F.element_at(p, -1)["k"],
        )

    weights = F.transform(F.sequence(lo, hi), lambda k: F.struct(k.alias("k"), F.exp(choose(good, k) + choose(bad, draws - k) - choose(good + bad, draws)).alias("p")))
    return F.when(lo == hi, lo).otherwise(bound(weights, picked))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(i, shard, first, n): of source i, shard ``shard`` gets its drawn blocks first .. first+n-1.

    ``quotas`` has (i, quota); ``shards`` is a power of two.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "quota"))).alias("all")).select(
        F.lit(0).alias("node"), F.transform("all", lambda x: x["i"]).alias("ids"), F.transform("all", lambda x: x["quota"]).alias("q")
    )
    for level in range(shards.bit_length() - 1):

        def left(q: Column, level: int = level) -> Column:
            whole = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)

            def step(a: Column, x: Column) -> Column:
                u = _number(_hash(seed, F.lit(str(level)), F.col("node").cast("string"), x["i"].cast("string")), 1, 13) / float(16**13)
                return bound(
                    _hypergeometric(x["q"], a["rest"] - x["q"], a["draws"], u),
                    lambda h: F.struct((a["rest"] - x["q"]).alias("rest"), (a["draws"] - h).alias("draws"), F.concat(a["out"], F.array(h)).alias("out")),
                )

            return bound(whole, lambda n: F.aggregate(
                F.transform(q, lambda x, i: F.struct(x.alias("q"), i.alias("i"))),
                F.struct(n.alias("rest"), F.floor(n / 2).alias("draws"), F.array().cast("array<bigint>").alias("out")), step, lambda a: a["out"],
            ))

        halves = bound(left(F.col("q")), lambda a: F.array(
            F.struct((F.col("node") * 2).alias("node"), a.alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", a, lambda x, y: x - y).alias("q")),
        ))
        node = node.select("ids", F.explode(halves).alias("h")).select("ids", "h.node", "h.q")
    leaf = node.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("ids", "q")).alias("x")).select("shard", F.col("x.ids").alias("i"), F.col("x.q").alias("n"))
    order = Win.partitionBy("i").orderBy("shard").rowsBetween(Win.unboundedPreceding, -1)
    return leaf.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(__s, __no, source_size, i, target) from (__s, __no, source_size), a row a source.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating. The common share per weight is
    the largest over the sources, taken in the order in which they reach their limit.
    """
    every = Win.partitionBy()
    w = sizes.withColumn("i", F.row_number().over(Win.orderBy("__no", "__s")) - 1)
    w = w.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), F.col("i") % len(WEIGHTS)))
    w = w.withColumns({"limit": F.col("source_size") * REPEATS, "total": F.sum("source_size").over(every) * SHARE})
    order = Win.orderBy(F.col("limit") / F.col("w"), "i")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, Win.unboundedFollowing))
    w = w.withColumn("level", (F.col("total") - before) / after)
    return w.withColumn("target", F.least(F.col("limit").cast("double"), F.max("level").over(every) * F.col("w"))).drop("w", "limit", "total", "level")


def plan(slim: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """A row per block: the largest document key that epoch 0 and 1 draw (-1: none), single further keys, and the shards.

    ``slim`` is a stored table (__s, __no, __block, __key, size) of all documents.
    """
    sources = scratch(source_targets(slim.groupBy("__s", "__no").agg(F.sum("size").alias("source_size"))), "mix-sources")
    blocks = slim.groupBy("__s", "__no", "__block").agg(F.sum("size").alias("words")).join(sources, ["__s", "__no"])
    epochs = blocks.where("words > 0").withColumn("e", F.explode(F.array(*(F.lit(e) for e in range(REPEATS)))))
    h = _hash(seed, F.col("__s"), F.col("__no").cast("string"), F.col("e").cast("string"), F.col("__block").cast("string"))
    # Blocks of over a fiftieth of their source (there are none in a large source) go first if they fit, so that small ones meet the target.
    fits = F.col("words") <= F.col("target") - F.col("e") * F.col("source_size")
    order = Win.partitionBy("__s", "__no").orderBy("e", ~fits, F.col("words") * 50 <= F.col("source_size"), h, "__block")
    epochs = epochs.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(order) - 1)
    drawn = scratch(epochs.withColumn("room", F.col("target") - F.col("before")).where("room > 0"), "mix-blocks")
    # Of the block that does not fit whole, the first documents are drawn as far as they do.
    cut = slim.join(drawn.where("words > room").select("__s", "__no", "__block", "e", "room"), ["__s", "__no", "__block"])
    inside = Win.partitionBy("__s", "__no", "__block", "e").orderBy("__key")
    cut = cut.groupBy("__s", "__no", "__block", "e", "room", "__key").agg(F.sum("size").alias("size"))  # rows of one id go together
    cut = cut.withColumn("sum", F.sum("size").over(inside)).where("sum <= room").groupBy("__s", "__no", "__block", "e").agg(F.max("__key").alias("upto"), F.max("sum").alias("part"))
    quotas = scratch(split_quotas(drawn.groupBy("i").agg(F.count(F.lit(1)).alias("quota")), shards, seed), "mix-quotas")
    ranks = quotas.where("n > 0").select("i", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    drawn = drawn.join(ranks, ["i", "rank"], "left").join(cut, ["__s", "__no", "__block", "e"], "left")
    upto = F.when(F.col("words") <= F.col("room"), F.lit(ALL)).otherwise(F.coalesce("upto", F.lit(-1)))
    per_epoch = [f(F.when(F.col("e") == e, c)).alias(f"{n}{e}") for e in range(REPEATS) for n, f, c in (("upto", F.max, upto), ("shard", F.max, F.col("shard")))]
    taken = drawn.groupBy("__s", "__no", "__block").agg(*per_epoch)
    table = blocks.select("__s", "__no", "__block", "source_size", "target").join(taken, ["__s", "__no", "__block"], "left").fillna(-1, [f"upto{e}" for e in range(REPEATS)])
    # A few further documents, not yet drawn in this epoch, fill what is still missing: the largest that fits, at last the nearest.
    missing = drawn.where("words > room").select("__s", "__no", "e", (F.col("room") - F.coalesce("part", F.lit(0))).alias("missing"), F.col("shard").alias("to")).where("missing > 0")
    table, missing = scratch(table, "mix-table"), scratch(missing, "mix-missing")
    table = table.withColumns({"picks": F.array().cast("array<struct<e:int,key:bigint>>"), "to": F.lit(None).cast("int")})
    for last in [False] * (FILLS - 1) + [True]:
        used = F.get(F.array(*(F.col(f"upto{e}") for e in range(REPEATS))), F.col("e"))
        spare = slim.where("size > 0").join(table, ["__s", "__no", "__block"]).drop("to").join(F.broadcast(missing) if missing.count() <= SMALL else missing, ["__s", "__no"])
        spare = spare.where((F.col("__key") > used) & ~F.array_contains("picks", F.struct(F.col("e"), F.col("__key").alias("key"))))
        spare = spare.groupBy("__s", "__no", "__block", "__key", "e", "missing", "to").agg(F.sum("size").alias("size")).withColumn("off", F.abs(F.col("size") - F.col("missing")))
        spare = spare.where("off < missing" if last else "size <= missing")
        best = spare.groupBy("__s", "__no").agg(F.min(F.struct("off", "__block", "__key", "e", "to", "size")).alias("x"))
        best = scratch(best.select("__s", "__no", "x.__block", F.struct("x.e", F.col("x.__key").alias("key")).alias("pick"), F.col("x.to").alias("goes"), F.col("x.size").alias("found")), "mix-pick")
        table = table.join(best.drop("found"), ["__s", "__no", "__block"], "left").withColumns({
            "picks": F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("pick"))), "to": F.coalesce("goes", "to"),
        }).drop("pick", "goes")
        missing = missing.join(best.select("__s", "__no", "found"), ["__s", "__no"]).withColumn("missing", F.col("missing") - F.col("found")).drop("found").where("missing > 0")
    return table


def _draws(e: int) -> Column:
    return (F.col("__key") <= F.col(f"upto{e}")) | F.array_contains("picks", F.struct(F.lit(e).alias("e"), F.col("__key").alias("key")))


def _drawn() -> Column:
    """(shard, epoch) of every time that a document is drawn: by the shard that the tree gave its block to, or, as a fill, by that of the cut block."""
    shards = (F.struct(F.when(_draws(e), F.coalesce(F.when(F.col("__key") <= F.col(f"upto{e}"), F.col(f"shard{e}")), F.col("to"))).alias("shard"), F.lit(e).alias("epoch")) for e in range(REPEATS))
    return F.filter(F.array(*shards), lambda x: x["shard"].isNotNull())


def _slim(docs: DataFrame, seed: int, blocks: int | None, shards: int | None) -> tuple[DataFrame, int, int]:
    """Sizes and keys of all documents, stored once, the texts are read for nothing else; the numbers of blocks and shards."""
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    slim = scratch(_keyed(docs.select("doc_id", "text", "source"), seed).select("doc_id", "__s", "__no", "__h", "__key", size.alias("size")), "mix-sizes")
    if blocks is None or shards is None:
        words = int(slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        blocks = blocks or _grown(BLOCKS, MOST_BLOCKS, words, BLOCK_WORDS)
        shards = shards or _grown(SHARDS, MOST_SHARDS, int(words * SHARE), SHARD_WORDS)
    return _blocked(slim, blocks), blocks, shards


def _bounded(table: DataFrame) -> DataFrame:
    """Broadcast a table of blocks if it is small; its size grows with the sources and blocks."""
    table = scratch(table, "mix-plan")
    return F.broadcast(table) if table.count() <= SMALL else table


def mix_report(docs: DataFrame, blocks: int | None = None, seed: int = 0, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (those that draw it, one each time) of every document (see :func:`mix`)."""
    slim, blocks, shards = _slim(docs, seed, blocks, shards)
    found = slim.join(_bounded(plan(slim, shards, seed)), ["__s", "__no", "__block"]).withColumn("drawn", _drawn())
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("drawn")).alias("taken"), F.transform("drawn", lambda x: x["shard"]).alias("shards"))


def mix(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 0, with_shard: bool = False) -> DataFrame:
    """The mixed corpus: the drawn copies of the documents, by shard, in the shard's own random order.

    Sizes are words; null text has none and is never drawn, like any empty text. A null source is a
    source of its own; rows with one doc_id are drawn together, rows with a null one by their text.
    Blocks of over a fiftieth of their source, as there are in small sources only, are drawn first as far
    as they fit, so that a small source comes near its target; all other blocks are drawn in permuted
    order. An empty table gives an empty mix. All columns of ``docs`` stay, whatever
    their names; with ``with_shard`` the columns shard and epoch follow. A run with the same rows and
    seed gives the same mix.
    """
    slim, blocks, shards = _slim(docs, seed, blocks, shards)
    table = _bounded(plan(slim, shards, seed)).drop("source_size", "target")
    nonempty = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(nonempty).select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = _blocked(_keyed(rows, seed).select("__s", "__no", "__h", "__key", "row", F.col("doc_id").cast("string").alias("id")), blocks).join(table, ["__s", "__no", "__block"])
    out = out.select("row", "id", "__key", F.explode(_drawn()).alias("draw"))
    out = out.select("row", F.col("draw.shard").alias("shard"), F.col("draw.epoch").alias("epoch"), F.md5(F.concat_ws(":", F.lit(str(seed)), "draw.epoch", "__key", "id")).alias("order"))
    # A shard is a partition: its number is the partition's.
    out = out.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "order")
    return out.select("row.*", *(["shard", "epoch"] if with_shard else []))
