"""Collapsing, policy resolution, verdicts, redaction and history stripping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.functions import catalogue as cat
from dredgeline.functions import text as tx
from dredgeline.operators.extract import _get, _list, _str
from dredgeline.operators.filters import action_rank, severity_rank

#: Columns that order the findings of one request: field first, then rule, then match.
ORDER = ("field_no", "rule_no", "match_no")


def collapse(findings: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """One row per (keys, detector, type, value): the first occurrence and its count."""
    by = [*keys, "detector", "type", "value"]
    rest = [c for c in findings.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_f")
    return findings.groupBy(*by).agg(first, F.count("*").alias("count")).select(*by, "_f.*", "count")


def resolve_action(overrides: dict[str, str] | None = None, default: str = "alert", action: str = "action",
                   detector: str = "detector") -> Column:
    """A finding's own action, else its detector's override, else the default."""
    out = F.lit(default)
    for det, act in (overrides or {}).items():
        if act:
            out = F.when(F.col(detector) == det, act).otherwise(out)
    return F.coalesce(F.nullif(F.col(action), F.lit("")), out)


def winning_action(findings: DataFrame, keys: Sequence[str], default: str = "alert", order: Sequence[str] = ORDER,
                   more: Sequence[Column] = ()) -> DataFrame:
    """Per request: strongest action, never below the default, the finding behind it, and ``more`` aggregates of its findings."""
    floor = cat.ACTION_RANK.get(default, 0)
    rank = action_rank("action")
    lead = F.struct(F.when(rank > floor, -rank).otherwise(0), *[F.col(o) for o in order])
    best = F.min_by(
        F.struct(F.when(rank > floor, F.col("action")).otherwise(default).alias("a"),
                 F.concat("type", F.lit(" ("), "location", F.lit(")")).alias("r")), lead)
    return findings.groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("finding_count"), *more).select(
        "*", F.col("_b.a").alias("action"), F.col("_b.r").alias("reason")).drop("_b")


def request_verdicts(requests: DataFrame, findings: DataFrame, keys: Sequence[str], default: str = "alert",
                     order: Sequence[str] = ORDER, more: Sequence[Column] = ()) -> DataFrame:
    """Winning action of every request; those without findings pass, with null for ``more`` aggregates of findings."""
    won = winning_action(findings, keys, default, order, more)
    return requests.join(won, list(keys), "left").select(
        *requests.columns, *won.columns[len(keys) + 1:-2], F.coalesce("action", F.lit("pass")).alias("action"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"))


def exit_codes(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest code of each file's resolved actions (no default floor here)."""
    return findings.groupBy(*keys).agg(_exit_code(), F.count("*").alias("finding_count"))


def _exit_code() -> Column:
    code = F.lit(cat.EXIT_CODES["log"])
    for act, c in cat.EXIT_CODES.items():
        code = F.when(F.col("action") == act, c).otherwise(code)
    return F.min(code).alias("exit_code")


def scan_report(files: DataFrame, findings: DataFrame, key: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Per file: findings in order, their number and the exit code (0 when clean)."""
    item = F.struct(*[F.col(o) for o in order], "detector", "type", "severity", "location", "value_preview", "action", "count")
    told = findings.groupBy(key).agg(_exit_code(), F.count("*").alias("finding_count"), F.array_sort(F.collect_list(item)).alias("findings"))
    return files.select(key).join(told, key, "left").select(
        key, F.coalesce("finding_count", F.lit(0)).alias("finding_count"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"), "findings")


# ---- redaction -----------------------------------------------------------------------------
def redaction_list(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per text: (value, tag) pairs to replace, longest value first.

    A value found by several rules takes the tag of the most severe one, ties by detector
    and type. The list belongs to one text, so it is bounded by that text.
    """
    todo = findings.where((F.col("action") == "redact") & (F.col("value") != ""))
    rank = F.struct((-severity_rank("severity")).alias("s"), F.col("detector").alias("d"), F.col("type").alias("t"))
    per_value = todo.groupBy(*keys, "value").agg(F.min(rank).alias("_r"))
    item = F.struct((-F.length("value")).alias("n"), F.col("_r.s").alias("s"), F.col("_r.d").alias("d"), F.col("_r.t").alias("t"),
                    F.col("value").alias("value"))
    return per_value.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("redactions"))


def redact(texts: DataFrame, findings: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Replace every redact-action value by ``[REDACTED:type]``."""
    lists = redaction_list(findings, keys)
    new = F.aggregate(
        F.coalesce("redactions", F.array().cast("array<struct<n:int,s:int,d:string,t:string,value:string>>")),
        F.col(text),
        lambda acc, x: F.replace(acc, x["value"], F.concat(F.lit("[REDACTED:"), x["t"], F.lit("]"))),
    )
    return texts.join(lists, list(keys), "left").withColumn(text, new).drop("redactions")


# ---- history strip and block verdict ---------------------------------------------------------
def strip_history(df: DataFrame, body: str = "body", locations: str = "locations") -> DataFrame:
    """Remove blocked content that lies in the history of a request.

    ``locations`` is the array of finding locations of the request. Adds ``strip_kind``
    ('messages', 'blocks' or 'none') and ``stripped_body`` (NULL when it must be blocked).
    Everything happens inside the row.
    """
    loc = (
        f"transform(filter({locations}, l -> l rlike '\\\\Amessages\\\\[\\\\d+\\\\]\\\\.content(\\\\[\\\\d+\\\\])?(\\\\.|$)'), l -> "
        "struct(cast(regexp_extract(l, 'messages\\\\[(\\\\d+)\\\\]', 1) as int) as m, "
        "coalesce(try_cast(nullif(regexp_extract(l, '\\\\Amessages\\\\[\\\\d+\\\\]\\\\.content\\\\[(\\\\d+)\\\\]', 1), '') as int), -1) as b))"
    )
    out = df.withColumn("_v", F.expr(f"try_parse_json({body})"))
    out = out.withColumn("_msgs", F.expr(_list("_v", "$.messages"))).withColumn("_loc", F.expr(loc))
    out = out.withColumn("_roles", F.expr(f"transform(_msgs, m -> coalesce({_str('m', '$.role')}, ''))"))
    out = out.withColumn("_last", F.expr("size(_roles) - array_position(reverse(_roles), 'user')")).withColumn(
        "_last", F.expr("CASE WHEN array_contains(_roles, 'user') THEN cast(_last as int) ELSE -1 END"))
    out = out.withColumn("_old", F.expr("array_distinct(transform(filter(_loc, x -> x.m <> _last), x -> x.m))"))
    out = out.withColumn("_gone", F.expr(
        "array_union(_old, transform(filter(_old, i -> i + 1 < size(_roles) AND get(_roles, i + 1) = 'assistant'), i -> i + 1))"))
    out = out.withColumn("_blocks", F.expr(_list("get(_msgs, _last)", "$.content")))
    out = out.withColumn("_bad", F.expr("array_distinct(transform(_loc, x -> x.b))"))
    kind = F.expr(
        "CASE WHEN size(_msgs) = 0 OR size(_loc) = 0 OR _last < 0 THEN 'none' "
        "WHEN size(_old) > 0 THEN CASE WHEN exists(_loc, x -> x.m = _last) "
        "OR forall(sequence(0, size(_msgs) - 1), i -> array_contains(_gone, i)) THEN 'none' ELSE 'messages' END "
        "WHEN exists(_bad, b -> b < 0 OR b >= size(_blocks) - 1) THEN 'none' ELSE 'blocks' END")
    out = out.withColumn("strip_kind", kind)
    last_msg = (
        "to_variant_object(map_concat(map_filter(try_variant_get(m, '$', 'map<string,variant>'), (k, w) -> k <> 'content'), "
        "map('content', to_variant_object(filter(_blocks, (b, j) -> NOT array_contains(_bad, j))))))"
    )
    msgs = (
        "CASE strip_kind WHEN 'messages' THEN filter(_msgs, (m, i) -> NOT array_contains(_gone, i)) "
        f"WHEN 'blocks' THEN transform(_msgs, (m, i) -> if(i = _last, {last_msg}, m)) END"
    )
    rebuilt = (
        "to_json(to_variant_object(map_concat(map_filter(try_variant_get(_v, '$', 'map<string,variant>'), (k, w) -> k <> 'messages'), "
        f"map('messages', to_variant_object({msgs})))))"
    )
    out = out.withColumn("stripped_body", F.expr(f"CASE WHEN strip_kind <> 'none' THEN {rebuilt} END"))
    return out.select(*df.columns, "strip_kind", "stripped_body")


def block_verdict(df: DataFrame, action: str = "action", strip_kind: str = "strip_kind", types: str = "types") -> DataFrame:
    """Final outcome of a request: blocked, stripped, redacted or passed, with its message."""
    a, s = F.col(action), F.col(strip_kind)
    verdict = F.when((a == "block") & (s != "none"), "strip").when(a == "block", "block").when(a == "redact", "redact").otherwise("pass")
    msg = F.when((a == "block") & (s == "none"), F.concat(
        F.lit("Request blocked: sensitive data detected ("), F.array_join(types, ", "), F.lit(").")))
    return df.withColumn("verdict", verdict).withColumn("message", F.coalesce(msg, F.lit("")))


def framework_findings(df: DataFrame, keys: Sequence[str], body: str = "body", limit: int = 10 * 1024 * 1024,
                       failed: str | None = None) -> DataFrame:
    """Synthetic findings: a body too large to scan, or a row whose scan failed."""
    size = F.octet_length(F.col(body))
    over = F.when(size > limit, F.struct(
        F.lit("scan_skipped_oversized").alias("type"), F.lit("warning").alias("severity"), F.lit("log").alias("action"),
        F.lit("request_body").alias("location"), F.concat(size.cast("string"), F.lit(" bytes")).alias("value_preview")))
    err = F.when(F.col(failed) if failed else F.lit(False), F.struct(
        F.lit("scan_error").alias("type"), F.lit("critical").alias("severity"), F.lit("alert").alias("action"),
        F.lit("pipeline").alias("location"), F.lit("scan failed, request forwarded unscanned").alias("value_preview")))
    return df.select(*keys, F.explode(F.array_compact(F.array(over, err))).alias("_f")).select(
        *keys, F.lit("proxy").alias("detector"), "_f.*", F.lit("").alias("value"), F.lit("framework").alias("origin"))


def secure_columns(findings: DataFrame, hmac_key: bytes = b"") -> DataFrame:
    """What may be stored: hashes instead of the value, which is dropped."""
    vh = tx.hmac_sha256(hmac_key, "value") if hmac_key else F.lit("")
    return findings.withColumn("content_hash", tx.content_hash("detector", "type", "value")).withColumn("value_hash", vh).drop("value")


def sessionless(findings: DataFrame, session: str = "session_id", provider: str = "provider") -> DataFrame:
    """Findings that carry no session, per provider: these bypass every dedup layer."""
    return findings.where(F.col(session) == "").groupBy(provider).agg(F.count("*").alias("findings"))
