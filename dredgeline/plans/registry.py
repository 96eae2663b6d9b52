"""Query registry: named jobs over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredgeline.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-31"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# ---- inputs derived from the tables, once per dialect ------------------------------------------
# The findings table: every event stands for one finding. Written in the SQL both engines share.
_FINDINGS = """
SELECT event_id AS id, 1 AS namespace_id, ts AS timestamp,
  CASE event_type WHEN 'error' THEN 'secrets' WHEN 'purchase' THEN 'pii' WHEN 'signup' THEN 'proprietary'
                  WHEN 'view' THEN 'injection' ELSE 'custom' END AS detector,
  concat(event_type, '_', CAST(k % 30 AS STRING)) AS finding_type,
  CASE WHEN value > 30 THEN 'critical' WHEN value > 15 THEN 'high' WHEN value > 5 THEN 'warning' ELSE 'info' END AS severity,
  concat('messages[', CAST(k AS STRING), '].content') AS location,
  CASE WHEN value > 40 THEN 'block' WHEN value > 20 THEN 'redact' WHEN value > 10 THEN 'alert' WHEN value > 5 THEN 'log' ELSE '' END AS action_taken,
  CASE user_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'gemini' ELSE '' END AS provider,
  CASE WHEN k % 7 = 0 THEN '' ELSE concat('model-', CAST(k % 25 AS STRING)) END AS model,
  concat(event_type, ' value ', CAST(k % 10 AS STRING)) AS value,
  CASE WHEN user_id % 6 = 0 THEN '' ELSE concat('acct-', CAST(user_id % 40 AS STRING)) END AS account_id,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('s-', CAST(user_id AS STRING)) END AS session_id,
  concat('dev-', CAST(user_id % 3 AS STRING)) AS device_id,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN concat('C:', chr(92), 'proj', chr(92), 'p', CAST(k AS STRING))
       ELSE concat('/home/u_x/p', CAST(k AS STRING)) END AS working_directory,
  concat('branch-', CAST(k % 4 AS STRING)) AS git_branch,
  CASE WHEN k % 3 = 0 THEN '' ELSE concat('client-', CAST((k + user_id) % 60 AS STRING)) END AS client_name,
  CASE WHEN event_type = 'error' THEN 'framework' ELSE 'detector' END AS origin,
  user_id, k, event_type
FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
"""
FINDINGS_SQL = _FINDINGS.format(events="events")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_FINDINGS.format(events="{e}"), e=table(spark, sf, "events"))


def with_findings(body: str) -> str:
    return f"WITH f AS ({FINDINGS_SQL}) {body}"


def jstr(x: str) -> str:
    """SQL: a JSON string literal."""
    return f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"


#: Lines of a document with their index, in DuckDB.
LINES_SQL = (
    "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d)"
)


def md5(c: str = "text") -> F.Column:
    return F.md5(F.col(c)).alias("md5")
