"""Sinks and sources of governed tables: rules, baselines, audit, findings, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.operators.detect import valid_regex
from dredgeline.operators.governance import BASELINE_KEY
from dredgeline.operators.policy import secure_columns
from dredgeline.sources import findings_store

_RULE_JSON = ("struct<rules: array<struct<name: string, pattern: string, detector: string, severity: string, action: string, "
              "tier: string, description: string, tags: array<string>, validator: string, entropy_context: boolean>>>")


# ---- rules -----------------------------------------------------------------------------------
def read_rule_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON bundle, with ``valid`` telling whether the pattern compiles."""
    schema = T._parse_datatype_string(_RULE_JSON)
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).selectExpr("inline(rules)")
    # The scan's plan is made from these patterns, so they fit the driver, where the scan's engine tests them.
    broken = [r.pattern for r in raw.select("pattern").distinct().toLocalIterator() if r.pattern and not valid_regex(r.pattern)]
    return raw.withColumn("valid", ~F.coalesce("pattern", F.lit("")).isin(broken) if broken else F.lit(True)).fillna(
        {"detector": "secrets", "severity": "high", "action": "", "description": "", "validator": "", "entropy_context": False})


def export_rules(rules: DataFrame, path: str | None = None, tier: str = "", detector: str = "") -> DataFrame:
    out = rules
    if tier:
        out = out.where(F.col("tier") == tier)
    if detector:
        out = out.where(F.col("detector") == detector)
    out = out.orderBy("rule_id")
    if path:
        out.write.mode("overwrite").json(path)
    return out


# ---- allowlist -----------------------------------------------------------------------------------
def merge_allowlists(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Configured entries (always on) and enabled stored ones."""
    on = stored.where("enabled").select("list_type", "pattern")
    return configured.select("list_type", "pattern").unionByName(on).withColumn("enabled", F.lit(True))


# ---- baseline -------------------------------------------------------------------------------------
def baseline_rows(findings: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    return findings.select("detector", "type", F.col(file).alias("file"), F.sha2(F.col(value), 256).alias("value_hash")).orderBy("file", "type", "value_hash")


def write_baseline(findings: DataFrame, path: str, file: str = "file", value: str = "value") -> None:
    baseline_rows(findings, file, value).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant read: a missing path or malformed lines give fewer rows, not an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BASELINE_KEY])
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).dropna()
    except AnalysisException:
        return spark.createDataFrame([], schema)


# ---- audit --------------------------------------------------------------------------------------------
AUDIT_SESSION = ("account_id", "session_id", "device_id", "source_ip", "working_directory", "git_branch", "os_platform", "hostname",
                 "username", "client_name", "client_version", "client_type", "raw_user_agent", "api_format", "sdk_name", "sdk_version",
                 "runtime", "original_host")


def audit_entries(requests: DataFrame, findings: DataFrame, key: str = "request_id", order: Sequence[str] = ("field_no", "rule_no", "match_no")) -> DataFrame:
    """One record per request with its findings nested; blank session fields become NULL (omitted
    from JSON); the raw value and the API-key hash never appear."""
    item = F.struct(*[F.col(o) for o in order], "detector", "type", "severity", "location", "value_preview",
                    F.col("action").alias("action_taken"), "count", F.lit("detector").alias("origin") if "origin" not in findings.columns else F.col("origin"))
    names = ("detector", "type", "severity", "location", "value_preview", "action_taken", "count", "origin")
    lists = findings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_f"))
    have = set(requests.columns)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    j = requests.join(lists, key, "left")
    return j.select(
        *[c for c in ("timestamp", key, "provider", "model", "endpoint", "action", "request_size_bytes", "passed") if c in have],
        F.coalesce(F.transform("_f", lambda f: F.struct(*[f[n].alias(n) for n in names])), F.array()).alias("findings"),
        *[F.round("scan_duration_ms", 2).alias("scan_duration_ms")] if "scan_duration_ms" in have else [],
        *[blank(c) for c in AUDIT_SESSION if c in have],
        (F.coalesce(F.nullif(F.col("intercept_mode"), F.lit("")), F.lit("reverse")) if "intercept_mode" in have else F.lit("reverse")).alias("intercept_mode"))


def write_audit(entries: DataFrame, path: str, ts: str = "timestamp") -> None:
    """JSON lines under one directory per day; NULLs are omitted."""
    entries.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").option("ignoreNullFields", "true").json(path)


AUDIT_SCHEMA = (
    "timestamp timestamp_ntz, request_id bigint, provider string, model string, endpoint string, action string, request_size_bytes bigint, passed boolean, "
    "findings array<struct<detector: string, type: string, severity: string, location: string, value_preview: string, action_taken: string, "
    "count: bigint, origin: string>>, scan_duration_ms double, " + ", ".join(f"{c} string" for c in AUDIT_SESSION) + ", intercept_mode string"
)


def read_audit(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Newest entries first, malformed lines dropped, ``finding_count`` added."""
    df = spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    out = df.withColumn("finding_count", F.coalesce(F.size("findings"), F.lit(0))).orderBy(F.desc("timestamp"), F.desc("request_id"))
    return out.limit(limit) if limit else out


# ---- findings -------------------------------------------------------------------------------------------
def write_findings(findings: DataFrame, path: str, hmac_key: bytes = b"", ts: str = "timestamp", batch_id: int | None = None) -> None:
    """Add new findings to the stored table (:mod:`findings_store`); values are hashed before anything is written.

    A stream passes its batch id: a batch replayed after a failure counts once.
    """
    safe = secure_columns(findings, hmac_key) if "value" in findings.columns else findings
    findings_store.add(safe, path, ts, batch_id=batch_id)


def read_findings(spark: SparkSession, path: str) -> DataFrame | None:
    return findings_store.read(spark, path)


# ---- exports ----------------------------------------------------------------------------------------------
#: The columns of both exports, in order.
FINDINGS_CSV = ("id", "timestamp", "detector", "finding_type", "severity", "location", "action_taken", "provider", "model", "value_preview",
                "account_id", "session_id", "client_name", "origin")
AUDIT_CSV = ("timestamp", "request_id", "provider", "model", "endpoint", "action", "finding_count", "scan_duration_ms", "request_size_bytes", "passed")


def csv_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def csv_line(columns: Sequence[str | Column]) -> Column:
    """One quoted CSV record: fields with a comma, quote or line end are quoted, quotes doubled."""
    def q(c):
        s = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
        return F.when(s.rlike(r"[,\"\r\n]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *[q(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    csv_rows(df, columns).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)
