"""Reports over the findings table. ``as_of`` stands for "now"; every top-k breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dredgeline.functions import text as tx
from dredgeline.operators.filters import since_days, since_hours

ACTIONS = ("block", "redact", "alert", "log")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _n(name: str = "cnt") -> Column:
    return F.count("*").alias(name)


def totals(f: DataFrame, as_of: str) -> DataFrame:
    today = F.to_date("timestamp") == F.to_date(F.lit(as_of))
    return f.agg(_n("total_findings"), F.coalesce(F.sum(today.cast("bigint")), F.lit(0)).alias("today_count"),
                 F.max("timestamp").alias("last_finding_time"))


def count_by(f: DataFrame, col: str, blank: str | None = None, skip_blank: bool = False, top: int | None = None) -> DataFrame:
    """Counts per value of a column; '' can be shown as another word or left out."""
    x = f.where(F.col(col) != "") if skip_blank else f
    out = x.groupBy(F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(blank)).alias(col) if blank else F.col(col)).agg(_n())
    return out.orderBy(F.desc("cnt"), col).limit(top) if top else out


def daily_trend(f: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return f.where(since_days("timestamp", as_of, days)).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(_n())


def action_trend(f: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    act = F.coalesce(F.nullif(F.col("action_taken"), F.lit("")), F.lit("log"))
    return f.where(since_days("timestamp", as_of, days)).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        *[F.sum((act == a).cast("bigint")).alias(a) for a in ACTIONS])


def activity_matrix(f: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Seven weekday rows, Monday first, each with 24 hourly counts, zero filled."""
    wd = F.weekday("timestamp")
    cells = f.where(since_days("timestamp", as_of, days)).groupBy(wd.alias("w"), F.hour("timestamp").alias("h")).agg(_n("c"))
    per = cells.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("m"))  # at most 24 entries
    grid = f.sparkSession.range(7).select(F.col("id").cast("int").alias("w"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0).cast("bigint")))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return grid.join(per, "w", "left").select(F.col("w").alias("weekday_no"), F.element_at(names, F.col("w") + 1).alias("weekday"), hours.alias("hours"))


def top_in_window(f: DataFrame, col: str, as_of: str, days: int = 30, limit: int = 8) -> DataFrame:
    return count_by(f.where(since_days("timestamp", as_of, days)), col, skip_blank=True, top=limit)


def account_stats(f: DataFrame, limit: int = 10) -> DataFrame:
    # Two-step distinct: (account, session) pairs first, so a hot account spreads over tasks.
    pairs = f.where(F.col("account_id") != "").groupBy("account_id", "session_id").agg(_n("n"))
    return pairs.groupBy("account_id").agg(F.sum("n").alias("finding_count"), F.count("*").alias("session_count")).orderBy(
        F.desc("finding_count"), "account_id").limit(limit)


def by_project(f: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    x = f.where((F.col("working_directory") != "") & since_days("timestamp", as_of, days))
    per = x.groupBy("working_directory").agg(
        _n("finding_count"), F.sum((F.col("severity") == "critical").cast("bigint")).alias("critical_count"),
        F.max("timestamp").alias("last_finding_at"),
        F.array_sort(F.collect_set(F.nullif(F.col("client_name"), F.lit("")))).alias("agents"))
    top = per.orderBy(F.desc("finding_count"), "working_directory").limit(limit)
    return top.withColumn("project_name", tx.project_name("working_directory"))


def total_count(f: DataFrame, severity: str = "", detector: str = "", provider: str = "") -> DataFrame:
    from dredgeline.operators.filters import findings_filter

    return findings_filter(f, severity=severity, detector=detector, provider=provider).agg(_n("total"))


def sessions(f: DataFrame, limit: int = 50) -> DataFrame:
    meta = ("provider", "model", "account_id", "device_id", "working_directory", "git_branch")
    return f.where(F.col("session_id") != "").groupBy("session_id").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), _n("finding_count"),
        *[F.max(c).alias(c) for c in meta]).orderBy(F.desc("last_seen"), "session_id").limit(limit)


def active_sessions(f: DataFrame, as_of: str, hours: int = 24, limit: int = 5) -> DataFrame:
    """Newest sessions with a severity breakdown; ``total`` counts all of them, not only the page."""
    x = f.where((F.col("session_id") != "") & since_hours("timestamp", as_of, hours))
    sev = [F.sum((F.col("severity") == s).cast("bigint")).alias(f"{s}_count") for s in ("critical", "high", "warning", "info")]
    per = x.groupBy("session_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), _n("finding_count"),
                                      *[F.max(c).alias(c) for c in ("account_id", "client_name", "working_directory")], *sev)
    total = per.agg(F.count("*").alias("total"))
    return per.orderBy(F.desc("last_seen"), "session_id").limit(limit).crossJoin(F.broadcast(total))  # one row


def rule_stats(rules: DataFrame) -> DataFrame:
    """One row per (dimension, value): overall, by tier, by detector, in one pass."""
    on = F.col("enabled").cast("bigint")
    dims = F.explode(F.array(F.struct(F.lit("all").alias("d"), F.lit("").alias("v")), F.struct(F.lit("tier").alias("d"), F.col("tier").alias("v")),
                             F.struct(F.lit("detector").alias("d"), F.col("detector").alias("v"))))
    return rules.select(dims.alias("x"), on.alias("on"), (F.col("tier") == "pro").cast("bigint").alias("pro")).groupBy(
        F.col("x.d").alias("dimension"), F.col("x.v").alias("value")).agg(
        _n("total"), F.sum("on").alias("enabled"), (F.count("*") - F.sum("on")).alias("disabled"), F.sum("pro").alias("pro_rules"))


def tag_stats(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("tags").alias("tag"), "enabled").groupBy("tag").agg(
        _n("total"), F.sum(F.col("enabled").cast("bigint")).alias("enabled")).orderBy("tag")


def connection_stats(conns: DataFrame, as_of_epoch: float, days: int = 7) -> DataFrame:
    x = conns.where(F.col("connected_at") >= as_of_epoch - days * 86400)
    z = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return x.agg(_n("total_connections"), z(F.sum("frames_sent"), "total_frames_sent"), z(F.sum("frames_received"), "total_frames_received"),
                 F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"), z(F.sum("findings_count"), "total_findings"))


def run_summary(results: DataFrame, ms: str = "scan_ms", size: str = "body_size", bins: int = 4096) -> DataFrame:
    """Requests, bytes, mean and nearest-rank p95 of the positive scan times.

    The p95 is the value at rank ``int(n * 0.95)``. A histogram of distinct values gives it
    without sorting all rows in one place: counts per value, then per range of values, then
    a running total over at most ``bins`` ranges and over the values of the one range hit.
    """
    x = results.where(F.col(ms) > 0).groupBy(F.col(ms).alias("v")).agg(_n("c"))
    top = x.agg(F.max("v").alias("hi"), F.sum("c").alias("n"))
    binned = x.crossJoin(F.broadcast(top)).withColumn("b", F.floor(F.col("v") / F.col("hi") * bins).cast("int"))
    per_bin = binned.groupBy("b").agg(F.sum("c").alias("bc"), F.max("n").alias("n"))
    run = F.sum("bc").over(W.partitionBy(F.lit(0)).orderBy("b"))
    rank = F.least((F.col("n") * F.lit(0.95)).cast("bigint"), F.col("n") - 1)
    hit = per_bin.withColumn("upto", run).withColumn("k", rank).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("bc") <= F.col("k"))).select(
        "b", (F.col("k") - (F.col("upto") - F.col("bc"))).alias("k"))
    vals = binned.join(F.broadcast(hit), "b").withColumn("r", F.sum("c").over(W.partitionBy("b").orderBy("v")))
    p95 = vals.where(F.col("r") > F.col("k")).agg(F.min("v").alias("p95"))
    base = results.agg(_n("total_requests"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes_scanned"),
                       F.coalesce(F.avg(F.when(F.col(ms) > 0, F.col(ms))), F.lit(0.0)).alias("m"))
    return base.crossJoin(F.broadcast(p95)).select("total_requests", "total_bytes_scanned", F.round("m", 1).alias("avg_scan_ms"),
                                                   F.round(F.coalesce("p95", F.lit(0.0)), 1).alias("p95_scan_ms"))


def detected_tools(seen: DataFrame, ts: str = "ts", order: str = "id") -> DataFrame:
    """First and last time, calls, and the latest non-empty description and schema per tool."""
    at = F.struct(F.col(ts), F.col(order))
    latest = lambda c: F.max_by(c, F.when(F.col(c) != "", at))
    return seen.where(F.col("tool_name") != "").groupBy("tool_name").agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), _n("call_count"),
        F.coalesce(latest("description"), F.lit("")).alias("description"), F.coalesce(latest("input_schema"), F.lit("{}")).alias("input_schema"))


def tool_calls(calls: DataFrame, session_id: str = "", limit: int | None = None, ts: str = "timestamp") -> DataFrame:
    x = calls.where(F.col("session_id") == session_id) if session_id else calls
    out = x.orderBy(F.desc(ts), F.desc("id"))
    return out.limit(limit) if limit else out


def agent_counts(agents: DataFrame) -> DataFrame:
    return agents.groupBy("status").agg(_n())


def audit_providers(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("provider") != "").select("provider").distinct().orderBy("provider")
