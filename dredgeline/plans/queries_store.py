"""Findings analytics, storage, dedup, governance and rule-overlap queries."""

from __future__ import annotations

import os
import tempfile
from dataclasses import replace

from pyspark.sql import functions as F

from dredgeline.operators import analytics as an
from dredgeline.operators import dedup, detect, filters, governance, overlap, policy
from dredgeline.plans.queries_scan import HITS, RULES, SEEDED, hits_sql, seeded_findings
from dredgeline.plans.registry import AS_OF, findings, query, table, with_findings
from dredgeline.session import ensure_checkpoint_dir
from dredgeline.sources import stores

_DAY = "strftime(timestamp, '%Y-%m-%d')"


def _since(days: int) -> str:
    return f"timestamp >= CAST(DATE '{AS_OF}' - INTERVAL {days} DAY AS TIMESTAMP)"


def work_dir(spark, name: str) -> str:
    """A fresh folder under the checkpoint directory, which is shared on a cluster."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    local = base[5:] if base.startswith("file:") else base
    if os.path.isdir(local):
        return tempfile.mkdtemp(prefix=f"{name}-", dir=local)
    return f"{base}/{name}-{os.urandom(6).hex()}"


# ---- reports ------------------------------------------------------------------------------------------
@query("a01_totals", with_findings(f"SELECT count(*) AS total_findings, count(*) FILTER (WHERE CAST(timestamp AS DATE) = DATE '2024-01-30') AS today_count, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_finding FROM f"))
def _a01(spark, sf):
    return an.totals(findings(spark, sf), "2024-01-30").select("total_findings", "today_count", F.date_format("last_finding_time", "yyyy-MM-dd HH:mm:ss").alias("last_finding"))


def _count(name, col, blank=None, skip=False, top=None):
    expr = f"coalesce(nullif({col}, ''), '{blank}')" if blank else col
    tail = f" ORDER BY cnt DESC, {col} LIMIT {top}" if top else ""
    sql = with_findings(f"SELECT * FROM (SELECT {expr} AS {col}, count(*) AS cnt FROM f{' WHERE ' + col + chr(32) + '<>' + chr(39) * 2 if skip else ''} GROUP BY 1) x{tail}")
    query(name, sql)(lambda spark, sf: an.count_by(findings(spark, sf), col, blank, skip, top))


_count("a02_by_severity", "severity")
_count("a03_by_detector", "detector")
_count("a04_top_types", "finding_type", top=20)
_count("a05_by_action", "action_taken")
_count("a06_by_provider", "provider", blank="unknown")
_count("a07_by_model", "model", blank="unknown", top=20)
_count("a08_by_client", "client_name", skip=True, top=50)
_count("o02_top_k", "location", top=5)


@query("a09_daily_trend", with_findings(f"SELECT {_DAY} AS day, count(*) AS cnt FROM f WHERE {_since(10)} GROUP BY 1"))
def _a09(spark, sf):
    return an.daily_trend(findings(spark, sf), AS_OF, 10)


@query("a10_action_trend", with_findings(f"SELECT {_DAY} AS day, " + ", ".join(f"count(*) FILTER (WHERE coalesce(nullif(action_taken, ''), 'log') = '{a}') AS \"{a}\"" for a in an.ACTIONS) + f" FROM f WHERE {_since(20)} GROUP BY 1"))
def _a10(spark, sf):
    return an.action_trend(findings(spark, sf), AS_OF, 20)


@query("a11_activity_matrix", with_findings(f"""
, g AS (SELECT w, h, (SELECT count(*) FROM f WHERE {_since(14)} AND isodow(timestamp) - 1 = w AND hour(timestamp) = h) AS c FROM range(7) a(w), range(24) b(h))
SELECT CAST(w AS INT) AS weekday_no, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][w + 1] AS weekday, array_to_string(list(c ORDER BY h), ',') AS hours FROM g GROUP BY w""").replace(") \n, g", "), g"))
def _a11(spark, sf):
    m = an.activity_matrix(findings(spark, sf), AS_OF, 14)
    return m.select("weekday_no", "weekday", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"))


@query("a12_top_accounts", with_findings(f"SELECT account_id, count(*) AS cnt FROM f WHERE account_id <> '' AND {_since(15)} GROUP BY 1 ORDER BY cnt DESC, account_id LIMIT 8"))
def _a12(spark, sf):
    return an.top_in_window(findings(spark, sf), "account_id", AS_OF, 15)


@query("a13_top_projects", with_findings(f"SELECT working_directory, count(*) AS cnt FROM f WHERE working_directory <> '' AND {_since(15)} GROUP BY 1 ORDER BY cnt DESC, working_directory LIMIT 8"))
def _a13(spark, sf):
    return an.top_in_window(findings(spark, sf), "working_directory", AS_OF, 15)


@query("a14_account_stats", with_findings("SELECT account_id, count(*) AS finding_count, count(DISTINCT session_id) AS session_count FROM f WHERE account_id <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _a14(spark, sf):
    return an.account_stats(findings(spark, sf))


@query("a15_by_project", with_findings(f"""
SELECT working_directory, count(*) AS finding_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_finding_at,
 coalesce(array_to_string(list_sort(list(DISTINCT client_name) FILTER (WHERE client_name <> '')), ','), '') AS agents, list_extract(string_split(replace(working_directory, chr(92), '/'), '/'), -1) AS project_name
FROM f WHERE working_directory <> '' AND {_since(30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _a15(spark, sf):
    p = an.by_project(findings(spark, sf), AS_OF)
    return p.withColumn("agents", F.array_join("agents", ",")).withColumn("last_finding_at", F.date_format("last_finding_at", "yyyy-MM-dd HH:mm:ss"))


@query("a16_filtered_total", with_findings("SELECT count(*) AS total FROM f WHERE severity = 'high' AND provider = 'openai'"))
def _a16(spark, sf):
    return an.total_count(findings(spark, sf), severity="high", provider="openai")


_META = ("provider", "model", "account_id", "device_id", "working_directory", "git_branch")


@query("a17_sessions", with_findings(f"""
SELECT session_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS finding_count,
 {', '.join(f'max({c}) AS {c}' for c in _META)} FROM f WHERE session_id <> '' GROUP BY 1 ORDER BY max(timestamp) DESC, 1 LIMIT 50"""))
def _a17(spark, sf):
    s = an.sessions(findings(spark, sf))
    return s.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("a18_active_sessions", with_findings("""
, g AS (SELECT session_id, max(timestamp) AS last_seen, count(*) AS finding_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
  count(*) FILTER (WHERE severity = 'info') AS info_count, max(client_name) AS client_name FROM f WHERE session_id <> '' AND timestamp >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1)
SELECT session_id, finding_count, critical_count, info_count, client_name, (SELECT count(*) FROM g) AS total FROM g ORDER BY last_seen DESC, session_id LIMIT 5""").replace(") \n, g", "), g"))
def _a18(spark, sf):
    return an.active_sessions(findings(spark, sf), "2024-01-30 00:00:00").select("session_id", "finding_count", "critical_count", "info_count", "client_name", "total")


# A rule table out of the part catalogue: one rule per part.
_RULE_COLS = """p_partkey AS rule_id, p_name AS name, concat(p_name, ' of ', p_brand) AS description, p_type AS detector,
 CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'warning' ELSE 'info' END AS severity,
 CASE p_partkey % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'custom' ELSE 'community' END AS tier, p_partkey % 3 <> 0 AS enabled, p_brand, p_size"""


def _rules(spark, sf):
    r = table(spark, sf, "part").selectExpr(*[c.strip() for c in _split_cols(_RULE_COLS)])
    return r.withColumn("tags", F.array("p_brand", F.concat(F.lit("size"), (F.col("p_size") % 7).cast("string"))))


def _split_cols(s):
    out, depth, cur = [], 0, ""
    for ch in s:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


_R = f"(SELECT {_RULE_COLS}, [p_brand, concat('size', CAST(p_size % 7 AS STRING))] AS tags FROM part)"


@query("a19_rule_stats", f"""
SELECT dimension, value, count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT enabled) AS disabled, count(*) FILTER (WHERE tier = 'pro') AS pro_rules FROM (
 SELECT 'all' AS dimension, '' AS value, enabled, tier FROM {_R} UNION ALL SELECT 'tier', tier, enabled, tier FROM {_R} UNION ALL SELECT 'detector', detector, enabled, tier FROM {_R}) x GROUP BY 1, 2""")
def _a19(spark, sf):
    return an.rule_stats(_rules(spark, sf))


@query("a20_tag_stats", f"SELECT tag, count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled FROM (SELECT unnest(tags) AS tag, enabled FROM {_R}) x GROUP BY 1")
def _a20(spark, sf):
    return an.tag_stats(_rules(spark, sf))


@query("f07_rule_search", f"SELECT rule_id, name FROM {_R} WHERE (name ILIKE '%RING%' OR description ILIKE '%ring%' OR name ILIKE '%brand#1%' OR description ILIKE '%brand#1%') AND list_contains(tags, 'size3') AND enabled")
def _f07(spark, sf):
    return filters.search_rules(_rules(spark, sf), "RING, brand#1", tag="size3", enabled=True).select("rule_id", "name")


@query("s13_rule_export", f"SELECT rule_id, name, severity FROM {_R} WHERE tier = 'custom' AND detector = 'ECONOMY'")
def _s13(spark, sf):
    return stores.export_rules(_rules(spark, sf), tier="custom", detector="ECONOMY").select("rule_id", "name", "severity")


@query("s05_rule_bundle", f"SELECT doc_id, type, sha256(value) AS value_hash FROM {HITS}")
def _s05(spark, sf):
    """The rule table as a bundle, with a broken rule added: written, read back, scanned."""
    path = work_dir(spark, "bundle")
    named = detect.rules_frame(spark, [*RULES, replace(RULES[0], name="broken", pattern="(?P<x>[a-z", rule_id=10_000)]).orderBy("rule_id")
    named.agg(F.collect_list(F.struct("name", "pattern", "detector", "severity", "action", "tier", "description", "tags", "validator", "entropy_context")).alias("rules")).write.mode("overwrite").json(path)
    rules = detect.active_rules(detect.rules_from_frame(stores.read_rule_bundle(spark, path).where("valid")))
    return seeded_findings(spark, sf, rules).select("doc_id", "type", F.sha2("value", 256).alias("value_hash"))


@query("s08_baseline_source", f"SELECT detector, type, CAST(doc_id AS STRING) AS file, sha256(value) AS value_hash FROM {HITS}")
def _s08(spark, sf):
    path = work_dir(spark, "baseline")
    stores.write_baseline(seeded_findings(spark, sf).withColumn("file", F.col("doc_id").cast("string")), path)
    return stores.read_baseline(spark, path)


_CONN = "SELECT o_orderkey AS id, epoch(o_orderdate) AS connected_at, o_totalprice / 1000 AS duration_seconds, o_custkey % 50 AS frames_sent, o_custkey % 70 AS frames_received, o_orderkey % 4 AS findings_count FROM orders"


@query("a21_connection_stats", f"""
SELECT count(*) AS total_connections, CAST(coalesce(sum(frames_sent), 0) AS BIGINT) AS total_frames_sent, CAST(coalesce(sum(frames_received), 0) AS BIGINT) AS total_frames_received,
 round(coalesce(avg(duration_seconds), 0), 6) AS avg_duration, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total_findings FROM ({_CONN}) c WHERE connected_at >= 1000000000 - 700 * 86400""")
def _a21(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("connected_at"), (F.col("o_totalprice") / 1000).alias("duration_seconds"),
                                          (F.col("o_custkey") % 50).alias("frames_sent"), (F.col("o_custkey") % 70).alias("frames_received"), (F.col("o_orderkey") % 4).alias("findings_count"))
    return an.connection_stats(c, 1000000000, 700).withColumn("avg_duration", F.round("avg_duration", 6))


@query("a22_run_summary", """
WITH n AS (SELECT count(*) AS n FROM events WHERE value > 0), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r FROM events WHERE value > 0)
SELECT (SELECT count(*) FROM events) AS total_requests, CAST((SELECT sum(user_id) FROM events) AS BIGINT) AS total_bytes_scanned,
 round((SELECT avg(value) FROM events WHERE value > 0), 1) AS avg_scan_ms, round((SELECT min(value) FROM s, n WHERE r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)), 1) AS p95_scan_ms""")
def _a22(spark, sf):
    return an.run_summary(table(spark, sf, "events").select(F.col("value").alias("scan_ms"), F.col("user_id").alias("body_size")))


@query("a23_detected_tools", with_findings("""
SELECT concat('tool-', CAST(k AS STRING)) AS tool_name, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS call_count,
 coalesce(arg_max(model, id) FILTER (WHERE model <> ''), '') AS description FROM f GROUP BY k"""))
def _a23(spark, sf):
    f = findings(spark, sf).select("id", F.col("timestamp").alias("ts"), F.format_string("tool-%d", "k").alias("tool_name"), F.col("model").alias("description"), F.lit("").alias("input_schema"))
    t = an.detected_tools(f)
    return t.select("tool_name", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "call_count", "description")


@query("a24_tool_call_chain", with_findings("SELECT id, finding_type AS tool_name, action_taken AS status FROM f WHERE session_id = 's-8' ORDER BY timestamp DESC, id DESC LIMIT 100"))
def _a24(spark, sf):
    c = findings(spark, sf).select("id", F.col("finding_type").alias("tool_name"), F.col("action_taken").alias("status"), "session_id", "timestamp")
    return an.tool_calls(c, "s-8").select("id", "tool_name", "status")


@query("a26_audit_providers", with_findings("SELECT DISTINCT provider FROM f WHERE provider <> ''"))
def _a26(spark, sf):
    return an.audit_providers(findings(spark, sf))


@query("l19_sessionless_findings", with_findings("SELECT provider, count(*) AS findings FROM f WHERE session_id = '' GROUP BY 1"))
def _l19(spark, sf):
    return policy.sessionless(findings(spark, sf))


@query("f06_findings_page", with_findings(f"SELECT id, severity, provider, working_directory FROM f WHERE provider = 'gemini' AND action_taken = 'block' AND contains(working_directory, 'u_x') AND {_since(10)} ORDER BY id DESC LIMIT 50 OFFSET 5"))
def _f06(spark, sf):
    f = filters.findings_filter(findings(spark, sf), "u_x", 10, AS_OF, provider="gemini", action_taken="block")
    return filters.page(f.select("id", "severity", "provider", "working_directory"), [F.desc("id")], 50, 5)


@query("o01_sorted_findings", with_findings("SELECT id, severity FROM f WHERE severity = 'critical'"))
def _o01(spark, sf):
    return findings(spark, sf).where("severity = 'critical'").select("id", "severity").orderBy(F.desc("id"))


@query("o03_pagination", with_findings("SELECT id, detector FROM f ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"))
def _o03(spark, sf):
    return filters.page(findings(spark, sf).select("id", "detector", "timestamp"), [F.desc("timestamp"), F.desc("id")], 20, 40).select("id", "detector")


@query("o04_point_lookup", with_findings("SELECT id, detector, finding_type, severity FROM f WHERE id = 77"))
def _o04(spark, sf):
    return findings(spark, sf).where("id = 77").select("id", "detector", "finding_type", "severity")


@query("f09_severity_floor", with_findings("SELECT id, severity FROM f WHERE severity IN ('high', 'critical')"))
def _f09(spark, sf):
    return filters.severity_floor(findings(spark, sf), "high").select("id", "severity")


@query("f10_audit_filter", with_findings("SELECT id, provider, model FROM f WHERE action_taken = 'alert' AND (contains(lower(location), 'model-1') OR contains(lower(model), 'model-1') OR contains(lower(provider), 'model-1'))"))
def _f10(spark, sf):
    a = findings(spark, sf).select("id", "provider", "model", F.col("location").alias("endpoint"), F.col("action_taken").alias("action"))
    return filters.audit_filter(a, "alert", search="MODEL-1").select("id", "provider", "model")


# ---- storage and dedup ------------------------------------------------------------------------------------
def _hashed(spark, sf):
    return policy.secure_columns(findings(spark, sf).withColumnRenamed("finding_type", "type")).withColumnRenamed("type", "finding_type")


_CH = "substr(sha256(concat(detector, '|', finding_type, '|', substr(sha256(value), 1, 16))), 1, 16)"


@query("l05_persistent_upsert", with_findings(f"""
SELECT {_CH} AS content_hash, session_id, min(id) AS id, arg_min(severity, id) AS severity, count(*) AS seen_count, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS ts FROM f WHERE session_id <> '' GROUP BY 1, 2
UNION ALL SELECT {_CH}, session_id, id, severity, 1, strftime(timestamp, '%Y-%m-%d %H:%M:%S') FROM f WHERE session_id = ''"""))
def _l05(spark, sf):
    f = _hashed(spark, sf)
    stored = dedup.upsert(None, f.where(F.col("timestamp") < "2024-01-15"))
    both = dedup.upsert(stored, f.where(F.col("timestamp") >= "2024-01-15"))
    return both.select("content_hash", "session_id", "id", "severity", "seen_count", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("s11_findings_sink", with_findings(f"SELECT {_CH} AS content_hash, session_id, count(*) AS seen_count FROM f WHERE session_id <> '' GROUP BY 1, 2 UNION ALL SELECT {_CH}, session_id, 1 FROM f WHERE session_id = ''"))
def _s11(spark, sf):
    path = work_dir(spark, "findings") + "/t"
    f = findings(spark, sf).withColumnRenamed("finding_type", "type")
    stores.write_findings(f.where(F.col("timestamp") < "2024-01-10"), path, b"pepper")
    stores.write_findings(f.where(F.col("timestamp") >= "2024-01-10"), path, b"pepper")
    return stores.read_findings(spark, path).select("content_hash", "session_id", "seen_count")


_TTL_SQL = """
, k AS (SELECT detector, event_type AS type, value, session_id, timestamp AS ts, min(id) AS id FROM f WHERE session_id <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY detector, type, value, session_id ORDER BY ts) AS n FROM k),
w AS (SELECT a.*, (SELECT min(b.n) FROM r b WHERE b.detector = a.detector AND b.type = a.type AND b.value = a.value AND b.session_id = a.session_id AND b.ts >= a.ts + INTERVAL {ttl} SECOND) AS nx FROM r a),
c AS (WITH RECURSIVE c AS (SELECT * FROM w WHERE n = 1 UNION ALL SELECT w.* FROM c JOIN w ON w.detector = c.detector AND w.type = c.type AND w.value = c.value AND w.session_id = c.session_id AND w.n = c.nx) SELECT * FROM c)
SELECT id FROM c UNION ALL SELECT id FROM f WHERE session_id = ''"""


def with_more(body: str) -> str:
    return with_findings("").rstrip() + body


@query("l09_finding_ttl_dedup", with_more(_TTL_SQL.format(ttl=86400)))
def _l09(spark, sf):
    f = findings(spark, sf).select("id", F.col("timestamp").alias("ts"), "detector", F.col("event_type").alias("type"), "value", "session_id")
    return dedup.finding_ttl(f, ttl_seconds=86400).select("id")


# Text dedup: each event is one request of two fields.
_FIELDS = ("(SELECT id AS req_id, session_id, timestamp AS ts, action_taken AS action, k % 4 = 0 AS stripped, unnest([concat('a', CAST(k % 20 AS STRING)), concat('b', CAST(k AS STRING))]) AS text FROM f)")


@query("l06_text_dedup", with_more(f"""
, q AS (SELECT id, session_id, timestamp AS ts, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id) > INTERVAL 40000 SECOND THEN 1 ELSE 0 END AS nw FROM f WHERE session_id <> ''),
e AS (SELECT id, sum(nw) OVER (PARTITION BY session_id ORDER BY ts, id) AS ep FROM q),
x AS (SELECT a.*, ep FROM {_FIELDS} a LEFT JOIN e ON e.id = a.req_id),
c AS (SELECT session_id, ep, text, min((ts, req_id)) AS first FROM x WHERE session_id <> '' AND (action NOT IN ('block', 'redact') OR (action = 'block' AND stripped)) GROUP BY ALL)
SELECT req_id, x.text, coalesce(c.first < (x.ts, x.req_id), false) AS skipped FROM x LEFT JOIN c ON c.session_id = x.session_id AND c.ep = x.ep AND c.text = x.text"""))
def _l06(spark, sf):
    f = findings(spark, sf).select(F.col("id").alias("req_id"), "session_id", F.col("timestamp").alias("ts"), F.col("action_taken").alias("action"), (F.col("k") % 4 == 0).alias("stripped"),
                                   F.explode(F.array(F.concat(F.lit("a"), (F.col("k") % 20).cast("string")), F.concat(F.lit("b"), F.col("k").cast("string")))).alias("text"))
    return dedup.seen_texts(f, stripped="stripped", ttl_seconds=40000).select("req_id", "text", "skipped")


@query("l08_resend_counts", with_more("""
, s AS (SELECT session_id, timestamp AS ts FROM f WHERE k % 3 = 0 AND session_id <> '')
SELECT id, (SELECT count(*) FROM s WHERE s.session_id = f.session_id AND s.ts > f.timestamp) AS resends FROM f WHERE session_id <> ''"""))
def _l08(spark, sf):
    f = findings(spark, sf).withColumnRenamed("timestamp", "ts")
    return dedup.resend_counts(f, f.where("k % 3 = 0"), bucket_seconds=86400)


_BUCKET_SQL = """
, k AS (SELECT id, detector, event_type, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY detector, event_type ORDER BY timestamp, id) AS n FROM f WHERE origin = 'framework'),
b AS (WITH RECURSIVE b AS (
  SELECT id, detector, event_type, us, n, true AS admitted, CAST({cap} - 1 AS DOUBLE) AS tokens FROM k WHERE n = 1
  UNION ALL SELECT id, detector, event_type, us, n, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (
    SELECT k.*, least(CAST({cap} AS DOUBLE), b.tokens + (k.us - b.us) * (CAST({cap} AS DOUBLE) / ({refill} * 1000000.0))) AS t
    FROM b JOIN k ON k.detector = b.detector AND k.event_type = b.event_type AND k.n = b.n + 1) q) SELECT * FROM b)
"""


def _limited(spark, sf):
    f = findings(spark, sf).select("id", F.col("timestamp").alias("ts"), "detector", F.col("event_type").alias("type"), "origin")
    return dedup.rate_limit(f, 3, 7200.0)


@query("l10_rate_limit", with_more(_BUCKET_SQL.format(cap=3, refill=7200) + "SELECT f.id, coalesce(b.admitted, true) AS admitted FROM f LEFT JOIN b ON b.id = f.id"))
def _l10(spark, sf):
    return _limited(spark, sf).select("id", "admitted")


@query("a28_suppression_counts", with_more(_BUCKET_SQL.format(cap=3, refill=7200) + "SELECT detector, event_type AS type, count(*) AS suppressed FROM b WHERE NOT admitted GROUP BY 1, 2"))
def _a28(spark, sf):
    return dedup.suppression_counts(_limited(spark, sf))


@query("l16_retention", with_findings(f"SELECT id FROM f WHERE timestamp >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 12 DAY"))
def _l16(spark, sf):
    return dedup.retain(findings(spark, sf), "timestamp", f"{AS_OF} 00:00:00", 12).select("id")


@query("l17_approval_expiry", with_findings("SELECT id, CASE WHEN action_taken = 'log' AND timestamp < TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' WHEN action_taken = 'log' THEN 'pending' ELSE 'approved' END AS status FROM f"))
def _l17(spark, sf):
    a = findings(spark, sf).select("id", F.when(F.col("action_taken") == "log", "pending").otherwise("approved").alias("status"), F.col("timestamp").alias("expires_at"))
    return governance.expire_approvals(a, "2024-01-20 00:00:00").select("id", "status")


@query("s09_audit_sink", with_findings("SELECT id AS request_id, nullif(account_id, '') AS account_id, 'reverse' AS intercept_mode, CASE WHEN action_taken <> '' THEN 1 ELSE 0 END AS n FROM f"))
def _s09(spark, sf):
    return _audit(spark, sf).select("request_id", "account_id", "intercept_mode", F.size("findings").alias("n"))


def _audit(spark, sf):
    f = findings(spark, sf)
    req = f.select(F.col("id").alias("request_id"), "timestamp", "provider", "model", F.col("location").alias("endpoint"), F.col("action_taken").alias("action"), "account_id", "session_id", F.lit("").alias("intercept_mode"))
    fs = f.where("action_taken <> ''").select(F.col("id").alias("request_id"), F.lit(0).alias("field_no"), F.lit(0).alias("rule_no"), F.lit(0).alias("match_no"), "detector", F.col("finding_type").alias("type"),
                                             "severity", "location", F.lit("x****").alias("value_preview"), F.col("action_taken").alias("action"), F.lit(1).cast("bigint").alias("count"), "origin")
    return stores.audit_entries(req, fs)


@query("s10_audit_source", with_findings("SELECT id AS request_id, CASE WHEN action_taken <> '' THEN 1 ELSE 0 END AS finding_count, account_id FROM (SELECT * EXCLUDE (account_id), nullif(account_id, '') AS account_id FROM f) f ORDER BY timestamp DESC, id DESC LIMIT 10000"))
def _s10(spark, sf):
    path = work_dir(spark, "audit") + "/t"
    stores.write_audit(_audit(spark, sf), path)
    return stores.read_audit(spark, path, 10_000).select("request_id", "finding_count", "account_id")


@query("s12_csv_export", with_findings("SELECT concat(CAST(id AS STRING), ',', detector, ',\"', concat(location, ', \"\"', severity, '\"\"'), '\",', sha256(value)) AS line FROM f"))
def _s12(spark, sf):
    f = findings(spark, sf).withColumn("value_hash", F.sha2("value", 256)).withColumn("note", F.concat("location", F.lit(', "'), "severity", F.lit('"')))
    return f.select(stores.csv_line(["id", "detector", "note", "value_hash"]).alias("line"))


# ---- governance --------------------------------------------------------------------------------------------------


@query("s14_alert_feed", with_findings("""
SELECT 'all' AS channel_id, id FROM f UNION ALL SELECT 'blocks', id FROM f WHERE action_taken = 'block' AND severity = 'critical'
UNION ALL SELECT 'mixed', id FROM f WHERE action_taken IN ('alert', 'log') AND severity IN ('high', 'critical')"""))
def _s14(spark, sf):
    ch = spark.createDataFrame([("all", [], "info"), ("blocks", ["block"], ""), ("mixed", ["alert", "log"], "high")], "channel_id string, events array<string>, min_severity string")
    return governance.route_alerts(findings(spark, sf), ch, "action_taken").select("channel_id", "id")


@query("j07_alert_routing", with_findings("SELECT 'mixed' AS channel_id, severity, count(*) AS n FROM f WHERE action_taken IN ('alert', 'log') AND severity IN ('high', 'critical', 'warning') GROUP BY 2"))
def _j07(spark, sf):
    ch = spark.createDataFrame([("mixed", ["alert", "log"], "warning")], "channel_id string, events array<string>, min_severity string")
    return governance.route_alerts(findings(spark, sf), ch, "action_taken").groupBy("channel_id", "severity").agg(F.count("*").alias("n"))


# Fleet: customers are agents, orders are the tools installed on them.
_AGENT = "SELECT c_custkey AS agent_id, c_name AS hostname, CASE c_custkey % 5 WHEN 0 THEN 'deregistered' WHEN 1 THEN 'stale' ELSE 'active' END AS status FROM customer"
_TOOL = "SELECT o_custkey AS agent_id, o_orderpriority AS client_id, concat('Tool ', o_orderpriority) AS display_name, o_orderkey % 3 = 0 AS proxy_configured, o_orderkey % 6 = 0 AS routing_active, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported' ELSE 'env_var' END AS proxy_config_type, o_orderkey FROM orders"


def _fleet(spark, sf):
    return (spark.sql(_AGENT.replace("FROM customer", "FROM {t}"), t=table(spark, sf, "customer")), spark.sql(_TOOL.replace("FROM orders", "FROM {t}"), t=table(spark, sf, "orders")))


@query("j04_fleet_tools", f"""
SELECT client_id, display_name, count(*) AS installed, count(*) FILTER (WHERE proxy_configured) AS configured, count(*) FILTER (WHERE routing_active) AS routing
FROM ({_TOOL}) t JOIN ({_AGENT}) a USING (agent_id) WHERE a.status <> 'deregistered' GROUP BY 1, 2""")
def _j04(spark, sf):
    return governance.fleet_tools(*_fleet(spark, sf))


@query("j05_fleet_gaps", f"""
SELECT agent_id, hostname, client_id, display_name, proxy_config_type, CASE WHEN proxy_config_type <> 'unsupported' THEN 1 ELSE 0 END AS actionable
FROM ({_TOOL}) t JOIN ({_AGENT}) a USING (agent_id) WHERE NOT proxy_configured AND a.status <> 'deregistered'""")
def _j05(spark, sf):
    return governance.fleet_gaps(*_fleet(spark, sf))


@query("a25_fleet_counts", f"SELECT status, count(*) AS cnt FROM ({_AGENT}) a GROUP BY 1")
def _a25(spark, sf):
    return an.agent_counts(_fleet(spark, sf)[0])


_EX = "SELECT p_partkey AS name, p_type AS pattern, CASE p_partkey % 4 WHEN 0 THEN 'yaml' WHEN 1 THEN 'dashboard' ELSE 'import' END AS source, p_brand AS action, p_partkey % 2 = 0 AS enabled, 'community' AS tier FROM part WHERE p_partkey % 5 <> 0"
_NEW = "SELECT p_partkey AS name, concat(p_type, p_size) AS pattern, p_name AS action FROM part WHERE p_partkey % 3 <> 0"


def _pair(spark, sf):
    p = table(spark, sf, "part")
    return spark.sql(_EX.replace("FROM part", "FROM {t}"), t=p), spark.sql(_NEW.replace("FROM part", "FROM {t}"), t=p)


@query("j06_declarative_reconcile", f"""
SELECT coalesce(e.name, d.name) AS name, CASE WHEN e.name IS NULL THEN 'create' WHEN d.name IS NOT NULL AND source = 'yaml' THEN 'update' WHEN d.name IS NOT NULL THEN 'conflict' WHEN source = 'yaml' THEN 'delete' ELSE 'keep' END AS change,
 CASE WHEN e.name IS NULL OR (d.name IS NOT NULL AND source = 'yaml') THEN d.pattern ELSE e.pattern END AS pattern, coalesce(source, 'yaml') AS source FROM ({_EX}) e FULL JOIN ({_NEW}) d ON e.name = d.name""")
def _j06(spark, sf):
    return governance.reconcile(*_pair(spark, sf), ["name"], "yaml", ["pattern"])


@query("j08_rule_import", f"""
SELECT coalesce(e.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'untouched' WHEN d.pattern LIKE '%7' OR (e.name IS NOT NULL AND source IN ('dashboard', 'yaml')) THEN 'skipped' WHEN e.name IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome
FROM (SELECT CAST(name AS STRING) AS name, source FROM ({_EX}) q) e FULL JOIN (SELECT CAST(name AS STRING) AS name, pattern FROM ({_NEW}) q) d ON e.name = d.name""")
def _j08(spark, sf):
    e, n = _pair(spark, sf)
    fill = {c: F.lit("") for c in ("detector", "severity", "description", "validator")}
    e = e.withColumn("name", F.col("name").cast("string")).withColumns(fill).withColumn("entropy_context", F.lit(False))
    n = n.withColumn("name", F.col("name").cast("string")).withColumns(fill).withColumn("entropy_context", F.lit(False))
    return governance.import_rules(e, n, valid=~F.col("pattern").endswith("7")).select("name", "outcome")


@query("s06_allowlist_merge", "SELECT CASE p_size % 3 WHEN 0 THEN 'secrets' WHEN 1 THEN 'pii' ELSE 'paths' END AS list_type, p_name AS pattern, count(*) AS n FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 2 = 1 GROUP BY 1, 2")
def _s06(spark, sf):
    p = table(spark, sf, "part").select(F.expr("CASE p_size % 3 WHEN 0 THEN 'secrets' WHEN 1 THEN 'pii' ELSE 'paths' END").alias("list_type"), F.col("p_name").alias("pattern"), (F.col("p_partkey") % 2 == 1).alias("enabled"), "p_partkey")
    m = stores.merge_allowlists(p.where("p_partkey % 4 = 0"), p.where("p_partkey % 4 <> 0"))
    return m.groupBy("list_type", "pattern").agg(F.count("*").alias("n"))


@query("u01_detector_union", f"SELECT detector, count(*) AS n FROM (SELECT detector FROM {HITS} UNION ALL SELECT 'proprietary' FROM {SEEDED} s WHERE contains(upper(text), 'TRADE SECRET')) x GROUP BY 1")
def _u01(spark, sf):
    from dredgeline.plans.queries_scan import seeded

    kw = detect.keywords(seeded(spark, sf), location=F.lit("t"), critical=("TRADE SECRET",), warning=(), carry=["doc_id"])
    return seeded_findings(spark, sf).select("detector").unionByName(kw.select("detector")).groupBy("detector").agg(F.count("*").alias("n"))


@query("j11_server_policy", """
SELECT s_suppkey, concat('srv-', CAST(s_nationkey AS STRING)) AS server_name, coalesce(CASE WHEN n_regionkey <> 4 THEN CASE n_regionkey WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'must_scan' ELSE 'review' END END, 'allow') AS policy
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def _j11(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.format_string("srv-%d", "s_nationkey").alias("server_name"))
    pol = table(spark, sf, "nation").select(F.format_string("srv-%d", "n_nationkey").alias("server_name"), F.expr("CASE n_regionkey WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'must_scan' WHEN 3 THEN 'review' ELSE 'bogus' END").alias("policy"), F.col("n_nationkey").alias("order_no"))
    return governance.server_policy(s, pol).select("s_suppkey", "server_name", "policy")


# ---- overlap -----------------------------------------------------------------------------------------------------
#: The shipped rules and four that match what some of them match: a duplicate, two subsets, a superset.
OVERLAPPING = [*RULES, *(
    detect.Rule(n, p, "pii", "warning", rule_id=1000 + i, use_group=False) for i, (n, p) in enumerate([
        ("mail_address", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), ("mail_org", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.org"),
        ("four_groups", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"), ("card_four", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ])
)]
_ITEMS = f"(SELECT DISTINCT detector, value AS item, type AS rule FROM {hits_sql(OVERLAPPING, SEEDED)})"
_PAIRS = f"""(WITH s AS {_ITEMS}, n AS (SELECT detector, rule, count(*) AS h FROM s GROUP BY ALL),
 c AS (SELECT a.detector, a.rule AS rule_a, b.rule AS rule_b, count(*) AS common FROM s a JOIN s b ON a.detector = b.detector AND a.item = b.item AND a.rule < b.rule GROUP BY ALL)
 SELECT c.*, common / x.h AS ab, common / y.h AS ba, common / (x.h + y.h - common) AS jac FROM c JOIN n x ON x.detector = c.detector AND x.rule = rule_a JOIN n y ON y.detector = c.detector AND y.rule = rule_b)"""


def _overlap(spark, sf):
    return overlap.overlap_pairs(seeded_findings(spark, sf, OVERLAPPING), ["value"])


@query("j13_rule_overlap", f"SELECT detector, rule_a, rule_b, CASE WHEN ab >= 0.8 AND ba >= 0.8 THEN 'duplicate' WHEN ab >= 0.8 THEN 'subset' WHEN ba >= 0.8 THEN 'superset' ELSE 'overlap' END AS relationship, common, round(jac, 6) AS jaccard FROM {_PAIRS} p")
def _j13(spark, sf):
    return _overlap(spark, sf).select("detector", "rule_a", "rule_b", "relationship", "common", F.round("jaccard", 6).alias("jaccard"))


@query("j12_dismissed_pairs", f"SELECT rule_a, rule_b, common FROM {_PAIRS} p WHERE rule_b NOT LIKE 'four%'")
def _j12(spark, sf):
    p = _overlap(spark, sf)
    gone = p.where(F.col("rule_b").startswith("four")).select(F.col("rule_b").alias("rule_a"), F.col("rule_a").alias("rule_b"))
    return overlap.drop_dismissed(p, gone).select("rule_a", "rule_b", "common")


@query("a29_rule_quality", f"""
WITH s AS {_ITEMS}, m AS (SELECT detector, item, count(*) AS r FROM s GROUP BY ALL), p AS {_PAIRS}
SELECT s.detector, rule, count(*) AS hits, round(count(*) / 100000, 6) AS breadth, round(count(*) FILTER (WHERE r = 1) / count(*), 6) AS unique_coverage, count(*) FILTER (WHERE r = 1) = 0 AS fully_redundant,
 (SELECT count(*) FROM p WHERE p.detector = s.detector AND (rule_a = rule OR rule_b = rule)) AS overlap_count FROM s JOIN m ON m.detector = s.detector AND m.item = s.item GROUP BY s.detector, rule""")
def _a29(spark, sf):
    f = seeded_findings(spark, sf, OVERLAPPING)
    q = overlap.rule_quality(f, ["value"], 100000, overlap.overlap_pairs(f, ["value"]))
    return q.select("detector", "rule", "hits", F.round("breadth", 6).alias("breadth"), F.round("unique_coverage", 6).alias("unique_coverage"), "fully_redundant", "overlap_count")


@query("a30_overlap_clusters", f"""
WITH p AS {_PAIRS}, e AS (SELECT rule_a AS a, rule_b AS b FROM p UNION SELECT rule_b, rule_a FROM p),
c AS (WITH RECURSIVE c AS (SELECT a AS rule, a AS reach FROM e UNION SELECT c.rule, e.b FROM c JOIN e ON e.a = c.reach) SELECT rule, min(reach) AS cluster FROM c GROUP BY rule)
SELECT cluster, rule, count(*) OVER (PARTITION BY cluster) AS size, rule = min(rule) OVER (PARTITION BY cluster) AS keep FROM c""")
def _a30(spark, sf):
    return overlap.clusters(_overlap(spark, sf), detect.rules_frame(spark, OVERLAPPING)).select("cluster", "rule", "size", "keep")
