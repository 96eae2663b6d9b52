"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A document is its words, weighted by how often they occur. Sample k of a document picks one word and
one weight level: every word x has, from hashes of (x, k), r and c drawn from a Gamma(2, 1)
distribution and b drawn from [0, 1); with t = floor(ln(w) / r + b) and y = exp(r * (t - b)) the word
with the least c / (y * exp(r)) is taken, together with its t. Two documents take the same (x, t) with a
probability that is their generalised Jaccard similarity, sum of least over sum of largest weights,
so the share of equal samples estimates it.

What is minimised is ln c - r * (t - b + 1), rounded to 2**-24 and packed into a long above 31 bits
that name (x, t): a plain minimum of longs, added up in place over the exploded words.

The documents that each one is compared with are the next by descending doc_id. Only keys are sorted
for that, in ranges; a text moves to its own key, and as much of it as is needed to its neighbour's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from dredgeline.llm.quality_rules import bound
from dredgeline.llm.store import scratch

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"
#: The low bits of a packed sample name its word and level.
NAMED = 2**31 - 1
#: Largest long: the order of a null doc_id, together with a flag of its own.
LAST = 2**63 - 1
KEY = ["none", "ord", "same"]


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))


def weighted_terms(text: Column) -> Column:
    """Array of (x, w): the hash of every distinct word and the logarithm of its count."""

    def counted(h: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.get(h, i - 1) != F.get(h, i - 2)))
        return bound(first, lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.array(F.size(h) + 1)), lambda a, b: F.struct(F.get(h, a - 1).alias("x"), F.ln((b - a).cast("double")).alias("w"))))

    return bound(F.array_sort(word_hashes(text)), lambda h: F.when(F.size(h) > 0, counted(h)))


def _bits(hashed: Column, first: int, count: int) -> Column:
    """``count`` bits of a hash as a number between 0 and 2**count, exclusive."""
    return F.shiftrightunsigned(hashed, first).bitwiseAND(F.lit(2**count - 1)) + F.lit(0.5)


def _gamma(a: Column, b: Column, bits: int) -> Column:
    """A draw from Gamma(2, 1): minus the log of a product of two uniforms, each ``bits`` bits long."""
    return F.lit(2 * bits * math.log(2)) - F.ln(a * b)


def sample(x: Column, log_weight: Column, k: int) -> Column:
    """The packed value of one weighted word for sample ``k``. Two hashes: r and b from the first, c from the second."""
    h = F.xxhash64(x, F.lit(k))
    g = F.xxhash64(h)
    r, log_c = _gamma(_bits(h, 0, 22), _bits(h, 42, 22), 22), F.ln(_gamma(_bits(g, 0, 31), _bits(g, 31, 31), 31))
    b = _bits(h, 22, 20) * F.lit(2.0**-20)
    t = F.floor(log_weight / r + b)
    # ln(c / (y * exp(r))) lies above -72 and below 4 for counts of up to 2**31.
    least = F.floor((log_c - r * (t - b + F.lit(1.0)) + F.lit(128.0)) * F.lit(2.0**24))
    return F.shiftleft(least, 31) + F.shiftrightunsigned(h, 33).bitwiseXOR(t.bitwiseAND(F.lit(NAMED)))


def signatures(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """``key`` and s, an array of ``samples`` packed samples, for every row of ``texts`` (key, terms); null without words.

    Where ``texts`` is already dealt out by some of ``key``, nothing is shuffled.
    """
    x = texts.select(*key, F.explode_outer("terms").alias("e")).select(*key, "e.x", "e.w")
    found = x.groupBy(*key).agg(*(F.min(sample(F.col("x"), F.col("w"), k)).alias(f"s{k}") for k in range(samples)))
    return found.select(*key, F.when(F.col("s0").isNotNull(), F.array(*(F.col(f"s{k}") for k in range(samples)))).alias("s"))


def fingerprint(s: Column) -> Column:
    """Eight hex digits a sample; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(s, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(NAMED)))), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 for one."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda p, q: p == q), lambda e: e))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(equal / F.size(a))


def _keys(docs: DataFrame) -> DataFrame:
    """docs with none, ord and same: sorted by them, documents come by descending doc_id, null last, then by the hash of their text."""
    did = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        did.isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(did), F.lit(LAST)).alias("ord"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text")
    )


def successors(docs: DataFrame) -> DataFrame:
    """KEY, n_chars, copies and next (a struct of KEY): the distinct (doc_id, text) and which one follows.

    Ranges of keys are sorted in parallel. The last of a range is followed by the first of the next one,
    and that of all by the first of all.
    """
    keys = _keys(docs).groupBy(*KEY).agg(F.max(F.length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    keys = scratch(keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "fingerprint-keys")
    keys = keys.withColumn("next", F.lead(F.struct(*KEY)).over(Win.partitionBy("range").orderBy(*KEY)))
    heads = keys.groupBy("range").agg(F.min(F.struct(*KEY)).alias("head"))  # a row for each range
    every = Win.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing))).alias("after"))
    return keys.join(F.broadcast(heads), "range").select(*KEY, "n_chars", "copies", F.coalesce("next", "after").alias("next"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text is the text whose last half of code points, rounded down, is replaced by the
    first as many, or all, of the next document's by descending doc_id; the last document is followed by the first.
    Null text is empty; texts without words have the empty fingerprint and are alike. Documents with
    one doc_id follow each other by the hash of their texts, equal ones directly; a null doc_id comes
    last and is returned as null. A single document follows itself. An empty table gives an empty
    result; other columns are ignored.
    """
    links = successors(docs)
    texts = _keys(docs).groupBy(*KEY).agg(F.first("text").alias("text"))  # copies of one doc_id and text are one row here
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = links.select(*(F.col(c).alias(f"to_{c}") for c in KEY), half.alias("half"), "next.*")
    heads = wanted.join(texts, KEY).select(*(F.col(f"to_{c}").alias(c) for c in KEY), F.expr("substring(text, 1, half)").alias("head"))
    # A key is a group of equal rows: all but the last are followed by their own text.
    own = texts.join(links, KEY).join(heads, KEY)
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))")
    again = F.expr("substring(text, 1, cast(floor(n_chars / 2) as int))")
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.concat(kept, F.col("head")).alias("t")), F.struct(F.lit(2).alias("v"), F.when(F.col("copies") > 1, F.concat(kept, again)).alias("t")))
    own = own.select(*KEY, "n_chars", "copies", "next", F.explode(F.filter(versions, lambda x: x["t"].isNotNull())).alias("x"))
    own = own.select(*KEY, "n_chars", "copies", "next", F.col("x.v").alias("v"), F.sha2("x.t", 256).alias("sha"), weighted_terms(F.col("x.t")).alias("terms"))
    signed = signatures(own, [*KEY, "n_chars", "copies", "next", "v", "sha"], samples)
    per_key = signed.groupBy(*KEY).agg(
        *(F.max(c).alias(c) for c in ("n_chars", "copies", "next")),
        *(F.max(F.when(F.col("v") == v, F.col(c))).alias(f"{c}{v}") for v in range(3) for c in ("s", "sha")),
    )
    stored = scratch(per_key, "fingerprint-signatures")
    after = stored.select(F.struct(*KEY).alias("next"), F.col("s0").alias("s_next"))
    both = stored.join(after, "next")
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("s1").alias("s"), F.col("sha1").alias("sha"), F.col("s_next").alias("n"))
    rest = F.struct((F.col("copies") - 1).alias("times"), F.col("s2").alias("s"), F.col("sha2").alias("sha"), F.col("s0").alias("n"))
    rows = both.withColumn("x", F.explode(F.when(F.col("copies") > 1, F.array(last, rest)).otherwise(F.array(last)))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.times"))))
    return rows.select(
        F.when(F.col("none") == 0, F.bitwise_not("ord")).alias("doc_id"), "n_chars", F.col("x.sha").alias("edited_sha256"), fingerprint(F.col("s0")).alias("fingerprint"),
        fingerprint(F.col("x.s")).alias("edited_fingerprint"), likeness(F.col("s0"), F.col("x.s")).alias("near_edited"), likeness(F.col("s0"), F.col("x.n")).alias("near_next"),
    )
