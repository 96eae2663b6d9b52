"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a condition on the text that rejects a document. Before the corpus is read, every rule
runs once on a bounded sample: its time per character is its cost, the share it rejects its
selectivity. The cascade is one ``CASE WHEN`` with the rules in falling order of rejection per cost,
so a costly rule is evaluated only for what the cheap ones let pass. The order changes the time
alone, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.llm.store import scratch

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return bound(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(text: Column) -> Column:
    """Words in windows of three that occur twice or more in the text, the first one included."""

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = bound(order, lambda s: F.transform(
            F.filter(s, lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False))),
            lambda e: e["i"],
        ))
        # Each repeated window adds the words that the one before it does not cover.
        return F.aggregate(
            F.sort_array(again), F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"],
        )

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return bound(words(text), of)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]


FEATURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
RULES = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: 100 * n_repeat_words(t) > 50 * n_words(t)),
    Rule("symbols", lambda t: 10 * n_symbols(t) > n_words(t)),
    Rule("repeated_lines", lambda t: 2 * n_dup_lines(t) > F.size(_lines(t))),
    Rule("capitals", lambda t: 2 * n_capitals(t) > word_chars(t)),
    Rule("word_length", lambda t: ~word_chars(t).between(2 * n_words(t), 15 * n_words(t))),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.cost


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = 400, fraction: float = 0.02) -> list[Measured]:
    """The rules in the order of the cascade, from a sample of at most ``rows`` documents."""
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(fraction, 7).limit(rows)
    sample = scratch(sample, "rule-sample")
    size, chars = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not size:
        return [Measured(r, 1.0, 0.0) for r in rules]

    def timed(condition: Column) -> tuple[float, int]:
        begun = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - begun, hits

    start = min(timed(F.length("text") < 0)[0] for _ in range(2))
    out = []
    for r in rules:
        spent, hits = timed(r.rejects(F.col("text")))
        out.append(Measured(r, max(spent - start, 1e-3) / max(chars, 1), hits / size))
    # A rule that rejects nothing in the sample goes last, the cheaper ones first.
    return sorted(out, key=lambda m: (-m.worth, m.cost))


def cascade(text: Column, ordered: Sequence[Measured]) -> Column:
    """Name of the first rule that rejects the text, null if none does."""
    out = F.lit(None).cast("string")
    for m in reversed(ordered):
        out = F.when(m.rule.rejects(text), F.lit(m.rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document.

    Null text counts as a text without words: it fails on length. Equal rows give equal rows, an
    empty table an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = order_rules(docs, rules)
    return docs.select("doc_id", *(f(text).alias(k) for k, f in FEATURES.items()), cascade(text, ordered).isNull().alias("passed")).select(
        "doc_id", *FEATURES, ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), "passed"
    ).withColumn("kept", ~F.col("base_failed") & F.col("passed")).drop("passed")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, all columns unchanged; a costly rule runs only on what is left."""
    return docs.where(cascade(F.coalesce(F.col("text"), F.lit("")), order_rules(docs, rules)).isNull())
