"""How rules overlap on real data: pairs, quality, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dredgeline.session import cut_lineage


def rule_sets(findings: DataFrame, item: Sequence[str], key: Sequence[str] = ("detector", "type")) -> DataFrame:
    """Per item, the rules that matched it. Rules are few, so the set per item is bounded by them."""
    return findings.groupBy(*item, "detector").agg(F.array_sort(F.collect_set("type")).alias("rules"))


def overlap_pairs(findings: DataFrame, item: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs of rules of one detector that match common items, with containment and Jaccard.

    Items are reduced to their distinct rule sets and counted first; pairs are then formed
    inside the few distinct sets, so a value found a billion times costs one row. A rule is
    counted as a pair with itself, so that the findings are read once.
    """
    sets = rule_sets(findings, item).groupBy("detector", "rules").agg(F.count("*").alias("n"))
    pair = F.expr("flatten(transform(rules, (a, i) -> transform(slice(rules, i + 1, size(rules)), b -> struct(a as rule_a, b as rule_b))))")
    both = sets.select("detector", F.explode_outer(pair).alias("p"), "n").groupBy(
        "detector", F.col("p.rule_a").alias("rule_a"), F.col("p.rule_b").alias("rule_b")).agg(F.sum("n").alias("common"))
    alone = F.max(F.when(F.col("rule_a") == F.col("rule_b"), F.col("common")))
    x = both.withColumn("hits_a", alone.over(W.partitionBy("detector", "rule_a"))).withColumn("hits_b", alone.over(W.partitionBy("detector", "rule_b")))
    x = x.where(F.col("rule_a") != F.col("rule_b"))
    x = x.withColumn("overlap_a_to_b", F.col("common") / F.col("hits_a")).withColumn("overlap_b_to_a", F.col("common") / F.col("hits_b"))
    x = x.withColumn("jaccard", F.col("common") / (F.col("hits_a") + F.col("hits_b") - F.col("common")))
    ab, ba = F.col("overlap_a_to_b") >= threshold, F.col("overlap_b_to_a") >= threshold
    kind = F.when(ab & ba, "duplicate").when(ab, "subset").when(ba, "superset").otherwise("overlap")
    return x.select("detector", "rule_a", "rule_b", kind.alias("relationship"), "common", "overlap_a_to_b", "overlap_b_to_a", "jaccard")


def drop_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Remove pairs someone has dismissed, whatever their order."""
    d = dismissed.select(F.least("rule_a", "rule_b").alias("_x"), F.greatest("rule_a", "rule_b").alias("_y")).distinct()
    return pairs.join(d, (F.least("rule_a", "rule_b") == F.col("_x")) & (F.greatest("rule_a", "rule_b") == F.col("_y")), "left_anti")


def rule_quality(findings: DataFrame, item: Sequence[str], corpus_size: int, pairs: DataFrame) -> DataFrame:
    """Breadth (share of the corpus matched), unique coverage (items matched by this rule
    alone) and whether other rules already cover everything it matches."""
    sets = rule_sets(findings, item).groupBy("detector", "rules").agg(F.count("*").alias("n"))
    per = sets.select("detector", F.explode("rules").alias("rule"), (F.size("rules") == 1).alias("alone"), "n").groupBy("detector", "rule").agg(
        F.sum("n").alias("hits"), F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("alone"))
    ends = pairs.select("detector", F.explode(F.array("rule_a", "rule_b")).alias("rule")).groupBy("detector", "rule").agg(F.count("*").alias("overlaps"))
    return per.join(ends, ["detector", "rule"], "left").select(
        "detector", "rule", "hits", (F.col("hits") / F.lit(corpus_size)).alias("breadth"),
        (F.lit(1.0) - F.col("hits") / F.lit(corpus_size)).alias("specificity"),
        (F.col("alone") / F.col("hits")).alias("unique_coverage"), F.coalesce("overlaps", F.lit(0)).alias("overlap_count"),
        (F.col("alone") == 0).alias("fully_redundant"))


def clusters(pairs: DataFrame, rules: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of the pair graph, by minimum-label propagation.

    Each round also jumps to the label's label, so chains close in logarithmic rounds; the
    state is checkpointed per round. ``keep`` marks the rule to retain: community before
    custom before pro, then by name.
    """
    edges = pairs.select("rule_a", "rule_b")
    edges = cut_lineage(edges.unionByName(edges.select(F.col("rule_b").alias("rule_a"), F.col("rule_a").alias("rule_b"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("rule_a").alias("rule")).agg(F.least(F.min("rule_a"), F.min("rule_b")).alias("cluster")))
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("rule").alias("rule_b"), "cluster"), "rule_b").groupBy(F.col("rule_a").alias("rule")).agg(
            F.min("cluster").alias("near"))
        step = labels.join(near, "rule", "left").withColumn("new", F.least("cluster", F.coalesce("near", F.col("cluster"))))
        jump = step.select(F.col("rule").alias("new"), F.col("new").alias("far"))
        nxt = cut_lineage(step.join(jump, "new", "left").select(
            "rule", F.least("new", F.coalesce("far", F.col("new"))).alias("cluster"), F.col("cluster").alias("old")))
        changed = nxt.where(F.col("cluster") != F.col("old")).limit(1).count()
        labels = nxt.drop("old")
        if not changed:
            break
    else:
        raise RuntimeError("label propagation did not settle; raise max_rounds")
    tier = F.when(F.col("tier") == "community", 0).when(F.col("tier") == "custom", 1).otherwise(2)
    ranked = labels.join(rules.select(F.col("name").alias("rule"), "tier").distinct(), "rule", "left")
    best = ranked.groupBy("cluster").agg(F.min_by("rule", F.struct(tier, "rule")).alias("_best"), F.count("*").alias("size"))
    return ranked.join(best, "cluster").select("cluster", "rule", "tier", "size", (F.col("rule") == F.col("_best")).alias("keep"))
