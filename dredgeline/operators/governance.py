"""Rule import, declarative reconcile, fleet reports, alert routing, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.operators.filters import severity_rank


# ---- declarative reconcile ------------------------------------------------------------------
def reconcile(existing: DataFrame, desired: DataFrame, keys: Sequence[str], source: str = "yaml",
              fields: Sequence[str] = (), owner: str = "source") -> DataFrame:
    """Change set that makes the rows of one source equal the desired ones.

    Rows of other sources are never touched; a desired name they hold is a conflict. Adds
    ``change`` (create, update, delete, conflict, keep) to the resulting row image.
    """
    keys, fields = list(keys), list(fields)
    e, d = existing.alias("e"), desired.alias("d")
    have, want = F.col(f"e.{keys[0]}").isNotNull(), F.col(f"d.{keys[0]}").isNotNull()
    mine = F.col(f"e.{owner}") == source
    change = (
        F.when(~have, "create").when(want & mine, "update").when(want, "conflict").when(mine, "delete").otherwise("keep")
    )
    cond = [F.col(f"e.{k}") == F.col(f"d.{k}") for k in keys]
    joined = e.join(d, cond, "full_outer").withColumn("change", change)
    pick = lambda c: F.when(F.col("change").isin("create", "update"), F.col(f"d.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return joined.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"d.{k}")).alias(k) for k in keys], *[pick(f) for f in fields],
                         F.coalesce(F.when(F.col("change") == "create", F.lit(source)), F.col(f"e.{owner}")).alias(owner), "change")


def apply_changes(changes: DataFrame) -> DataFrame:
    """New snapshot out of a change set."""
    return changes.where(F.col("change") != "delete").drop("change")


# ---- bulk rule import ------------------------------------------------------------------------
IMPORT_FIELDS = ("pattern", "detector", "severity", "description", "validator", "entropy_context")


def import_rules(existing: DataFrame, bundle: DataFrame, tier: str = "community", force: bool = False,
                 valid: Column | None = None) -> DataFrame:
    """Merge a rule bundle by name; adds ``outcome`` (created, updated, skipped, untouched).

    Import-owned rules take the new definition and keep action and enabled unless forced;
    rules owned by people or files are skipped. ``valid`` is a boolean over the bundle's
    columns that says whether the pattern compiles.
    """
    b = bundle.where(F.trim("name") != "").withColumn("name", F.trim("name")).withColumn(
        "_ok", F.coalesce(valid if valid is not None else F.lit(True), F.lit(True))).alias("b")
    e = existing.alias("e")
    have, got = F.col("e.name").isNotNull(), F.col("b.name").isNotNull()
    owned = F.col("e.source").isin("dashboard", "yaml")
    outcome = (
        F.when(~got, "untouched").when(~F.col("b._ok") | (have & owned), "skipped").when(have, "updated").otherwise("created")
    )
    j = e.join(b, F.col("e.name") == F.col("b.name"), "full_outer").withColumn("outcome", outcome)
    take = F.col("outcome").isin("created", "updated")
    cols = [F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in IMPORT_FIELDS]
    fresh = (F.col("outcome") == "created") | ((F.col("outcome") == "updated") & F.lit(force))
    return j.select(
        F.coalesce("e.name", "b.name").alias("name"), *cols,
        F.when(fresh, F.coalesce("b.action", F.lit(""))).otherwise(F.col("e.action")).alias("action"),
        F.when(fresh, F.lit(True)).otherwise(F.col("e.enabled")).alias("enabled"),
        F.when(F.col("outcome") == "created", F.lit(tier)).otherwise(F.col("e.tier")).alias("tier"),
        F.when(F.col("outcome") == "created", F.lit("import")).otherwise(F.col("e.source")).alias("source"),
        "outcome")


def import_counts(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("outcome") != "untouched").groupBy("outcome").agg(F.count("*").alias("rules"))


# ---- fleet ---------------------------------------------------------------------------------------
def fleet_tools(agents: DataFrame, tools: DataFrame) -> DataFrame:
    live = agents.where(F.col("status") != "deregistered").select("agent_id")
    s = lambda c, n: F.sum(F.col(c).cast("bigint")).alias(n)
    return tools.join(live, "agent_id").groupBy("client_id", "display_name").agg(
        F.count("*").alias("installed"), s("proxy_configured", "configured"), s("routing_active", "routing"))


def fleet_gaps(agents: DataFrame, tools: DataFrame, limit: int | None = None) -> DataFrame:
    live = agents.where(F.col("status") != "deregistered").select("agent_id", "hostname")
    out = tools.where(~F.col("proxy_configured")).join(live, "agent_id").select(
        "agent_id", "hostname", "client_id", "display_name", "proxy_config_type",
        (F.col("proxy_config_type") != "unsupported").cast("int").alias("actionable")).orderBy("hostname", "client_id", "agent_id")
    return out.limit(limit) if limit else out


# ---- alert routing ----------------------------------------------------------------------------------
def route_alerts(findings: DataFrame, channels: DataFrame, action: str = "action", max_channels: int = 1000) -> DataFrame:
    """Findings each channel receives: its events list (empty means all) and severity floor.

    The channel table is short configuration; its size is checked before it is broadcast.
    """
    n = channels.limit(max_channels + 1).count()
    if n > max_channels:
        raise ValueError(f"more than {max_channels} channels")
    c = F.broadcast(channels.select("channel_id", "events", F.coalesce(F.nullif(F.col("min_severity"), F.lit("")), F.lit("critical")).alias("_min")))
    hit = (F.size("events") == 0) | F.expr(f"array_contains(events, {action})")
    return findings.join(c, hit & (severity_rank("severity") >= severity_rank("_min"))).drop("events", "_min")


# ---- policies, approvals --------------------------------------------------------------------------
def server_policy(servers: DataFrame, policies: DataFrame, default: str = "allow", order: str = "order_no",
                  max_rows: int = 100_000) -> DataFrame:
    """First policy of each server name, else the default action."""
    first = policies.where((F.col("server_name") != "") & F.col("policy").isin("allowed", "blocked", "must_scan", "review")).groupBy(
        "server_name").agg(F.min_by("policy", order).alias("policy"))
    n = policies.limit(max_rows + 1).count()
    side = F.broadcast(first) if n <= max_rows else first
    return servers.join(side, "server_name", "left").withColumn("policy", F.coalesce("policy", F.lit(default)))


def expire_approvals(approvals: DataFrame, as_of: str) -> DataFrame:
    due = (F.col("status") == "pending") & (F.col("expires_at") < F.lit(as_of).cast("timestamp_ntz"))
    return approvals.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


# ---- baseline -------------------------------------------------------------------------------------
BASELINE_KEY = ("detector", "type", "file", "value_hash")


def suppress_baseline(findings: DataFrame, baseline: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Drop findings already accepted in the baseline."""
    keyed = findings.withColumn("_k", F.sha2(F.col(value), 256))
    b = baseline.select(*[F.col(c).alias(f"_b_{c}") for c in BASELINE_KEY]).distinct()
    cond = (F.col("detector") == F.col("_b_detector")) & (F.col("type") == F.col("_b_type")) & (
        F.col(file) == F.col("_b_file")) & (F.col("_k") == F.col("_b_value_hash"))
    return keyed.join(b, cond, "left_anti").drop("_k")


