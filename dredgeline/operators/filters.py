"""Allowlists, paging filters, rule search, tool lists, severity floor."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.functions import catalogue as cat
from dredgeline.functions import text as tx


def severity_rank(c: str | Column) -> Column:
    return _rank(c, cat.SEVERITY_RANK)


def action_rank(c: str | Column) -> Column:
    return _rank(c, cat.ACTION_RANK)


def _rank(c: str | Column, ranks: dict[str, int]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


# ---- allowlists --------------------------------------------------------------------------
def allowlist_globs(entries: DataFrame, max_entries: int = 100_000) -> dict[str, list[str]]:
    """Enabled entries (list_type, pattern) by list; the table is governed by hand, size checked."""
    rows = entries.where("enabled").select("list_type", "pattern").distinct().limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"allowlist holds more than {max_entries} entries")
    out: dict[str, list[str]] = {"secrets": [], "pii": [], "paths": []}
    for r in sorted(rows):
        out.setdefault(r["list_type"], []).append(r["pattern"])
    return out


def drop_allowed_paths(df: DataFrame, globs: Iterable[str], path: str = "source_filename") -> DataFrame:
    globs = list(globs)
    return df.where((F.col(path) == "") | ~tx.matches_glob(path, globs)) if globs else df


def drop_allowed_values(
    findings: DataFrame, secrets: Iterable[str] = (), pii: Iterable[str] = (), secret_detectors: Sequence[str] = ("secrets", "custom")
) -> DataFrame:
    """The secrets list covers secret and custom rules, the PII list PII only; no other detector."""
    secrets, pii = list(secrets), list(pii)
    out = findings
    if secrets:
        out = out.where(~(F.col("detector").isin(*secret_detectors) & tx.matches_glob("value", secrets)))
    if pii:
        out = out.where(~((F.col("detector") == "pii") & tx.matches_glob("value", pii)))
    return out


# ---- findings, rules, audit ---------------------------------------------------------------
PAGE_FILTERS = ("severity", "detector", "provider", "session_id", "account_id", "action_taken", "finding_type",
                "client_name", "hostname", "username", "sdk_name", "runtime", "intercept_mode", "original_host", "origin")


def since_days(ts: str, as_of: str, days: int) -> Column:
    """From midnight of the day ``days`` back."""
    return F.col(ts) >= F.date_sub(F.to_date(F.lit(as_of)), max(1, days))


def since_hours(ts: str, as_of: str, hours: int) -> Column:
    n = max(1, hours)
    return F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{n}' HOUR")


def findings_filter(df: DataFrame, working_directory: str = "", days: int = 0, as_of: str | None = None,
                    ts: str = "timestamp", namespace_id: int | None = None, **equals: str) -> DataFrame:
    """The findings page filter; empty values mean no condition. Pushes down to the scan."""
    unknown = set(equals) - set(PAGE_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = df if namespace_id is None else df.where(F.col("namespace_id") == namespace_id)
    for col, value in equals.items():
        if value:
            out = out.where(F.col(col) == value)
    if working_directory:
        out = out.where(tx.like_contains("working_directory", working_directory))
    if days > 0:
        out = out.where(since_days(ts, as_of, days))
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def search_rules(rules: DataFrame, search: str = "", detector: str = "", tier: str = "", severity: str = "",
                 tag: str = "", enabled: bool | None = None) -> DataFrame:
    """Comma-separated terms, any of which occurs in name or description; exact tag match."""
    out = rules
    terms = [t.strip() for t in search.split(",") if t.strip()]
    if terms:
        cond = F.lit(False)
        for t in terms:
            cond = cond | F.col("name").ilike(f"%{t}%") | F.col("description").ilike(f"%{t}%")
        out = out.where(cond)
    for col, value in (("detector", detector), ("tier", tier), ("severity", severity)):
        if value:
            out = out.where(F.col(col) == value)
    if enabled is not None:
        out = out.where(F.col("enabled") == enabled)
    if tag:
        out = out.where(F.array_contains("tags", tag))
    return out


def tool_allowed(tool: str | Column, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> Column:
    """A blocked name never passes; with an allow list, only listed names do."""
    t = F.col(tool) if isinstance(tool, str) else tool
    ok = F.lit(True)
    if blocked:
        ok = ok & ~t.isin(*blocked)
    if allowed:
        ok = ok & t.isin(*allowed)
    return ok


def severity_floor(df: DataFrame, minimum: str = "critical") -> DataFrame:
    return df.where(severity_rank("severity") >= cat.SEVERITY_RANK.get(minimum, 0))


def audit_filter(df: DataFrame, action: str = "", provider: str = "", search: str = "") -> DataFrame:
    out = df
    if action:
        out = out.where(F.col("action") == action)
    if provider:
        out = out.where(F.col("provider") == provider)
    if search:
        s = F.lit(search.lower())
        out = out.where(F.contains(F.lower("endpoint"), s) | F.contains(F.lower("model"), s) | F.contains(F.lower("provider"), s))
    return out
