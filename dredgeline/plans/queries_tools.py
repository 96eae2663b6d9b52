"""Tool protocol, responses, frames, plug-ins and streams over the given tables."""

from __future__ import annotations

from contextlib import contextmanager
from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.functions import text as tx
from dredgeline.operators import dedup, detect, governance, tooling
from dredgeline.plans import scan as jobs
from dredgeline.plans.plugins import Plugins
from dredgeline.plans.queries_scan import HITS, INJ, RULES, SEEDED, hits_sql, seeded, seeded_findings
from dredgeline.plans.queries_text import _requests
from dredgeline.plans.queries_store import _TTL_SQL, with_more, work_dir
from dredgeline.plans.registry import docs, findings, jstr, md5, query, spread, table, with_findings
from dredgeline.sources import files
from dredgeline.streaming import batches
from dredgeline.streaming import chunks as chunking
from dredgeline.streaming import state

SECRETS = [r for r in RULES if r.detector != "injection"]

# ---- messages: one JSON-RPC message per event ----------------------------------------------------------
# Every fifth event of a session is a tool list, the others are calls; ids repeat within a session.
_KIND = "CASE WHEN event_id % 5 = 0 THEN 'list' WHEN event_id % 5 = 4 THEN 'other' ELSE 'call' END"
_TOOLNAME = "concat('tool_', CAST(k % 12 AS STRING))"
_E = "(SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def _messages(spark, sf):
    e = spread(table(spark, sf, "events")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    tool = lambda j: (f"concat('{{\"name\":\"tool_', (k + {j}) % 12, '\",\"description\":\"does ', k % 12, '\",\"inputSchema\":{{\"type\":\"object\",\"properties\":{{\"b', k % 3, '\":{{}},\"a\":{{}}}}}}}}')")
    body = (
        f"CASE {_KIND} WHEN 'list' THEN concat('{{\"jsonrpc\":\"2.0\",\"id\":', event_id, ',\"result\":{{\"tools\":[', {tool(0)}, ',', {tool(1)}, ',', {tool(2)}, ',{{\"description\":\"nameless\"}}]}}}}') "
        "WHEN 'call' THEN concat('{\"jsonrpc\":\"2.0\",\"method\":\"tools/call\",\"id\":', if(event_id % 2 = 0, concat('\"', event_id % 7, '\"'), cast(event_id % 7 as string)), ',\"params\":{\"name\":\"tool_', k % 12, '\",\"arguments\":{\"q\":\"', event_type, ' user', user_id, '@example.com\"}}}') "
        "ELSE '{\"jsonrpc\":\"1.0\",\"method\":\"tools/call\"}' END"
    )
    return e.select(F.col("event_id").alias("msg_no"), "ts", F.concat(F.lit("s"), "user_id").alias("session_id"), "k", "event_type", "user_id", F.expr(body).alias("body"))


@query("s15_message_log", f"SELECT event_id AS msg_no, CASE {_KIND} WHEN 'call' THEN 'tools/call' END AS method, CASE {_KIND} WHEN 'list' THEN CAST(event_id AS STRING) ELSE CASE WHEN event_id % 2 = 0 THEN concat('\"', CAST(event_id % 7 AS STRING), '\"') ELSE CAST(event_id % 7 AS STRING) END END AS msg_id FROM {_E} e WHERE {_KIND} <> 'other'")
def _s15(spark, sf):
    return tooling.parse_messages(_messages(spark, sf)).select("msg_no", "method", "msg_id")


@query("e21_tool_call_parse", f"SELECT event_id AS msg_no, {_TOOLNAME} AS tool_name, concat('{{\"q\":\"', event_type, ' user', CAST(user_id AS STRING), '@example.com\"}}') AS arguments FROM {_E} e WHERE {_KIND} = 'call'")
def _e21(spark, sf):
    return tooling.tool_calls(tooling.parse_messages(_messages(spark, sf))).select("msg_no", "tool_name", "arguments")


@query("e22_tool_list_parse", f"SELECT event_id AS msg_no, CAST(j AS INT) AS tool_no, concat('tool_', CAST((k + j) % 12 AS STRING)) AS name, concat('does ', CAST(k % 12 AS STRING)) AS description FROM {_E} e, range(3) r(j) WHERE {_KIND} = 'list'")
def _e22(spark, sf):
    return tooling.tool_definitions(tooling.tool_lists(tooling.parse_messages(_messages(spark, sf)))).select("msg_no", "tool_no", "name", "description")


def _responses(spark, sf):
    body = f"concat('{{\"jsonrpc\":\"2.0\",\"id\":', doc_id, ',\"result\":{{\"content\":[{{\"type\":\"text\",\"text\":', {jstr('text')}, '}},{{\"type\":\"image\",\"text\":\"no\"}},{{\"type\":\"text\",\"text\":', {jstr('source')}, '}}]}}}}')"
    return seeded(spark, sf).select(F.col("doc_id").alias("msg_no"), F.expr(body).alias("body"))


@query("e23_tool_response_text", f"SELECT doc_id AS msg_no, md5(concat(text, chr(10), source)) AS md5 FROM {SEEDED} s")
def _e23(spark, sf):
    return tooling.response_texts(tooling.parse_messages(_responses(spark, sf))).select("msg_no", md5())


_RESP = f"(SELECT doc_id, concat(text, chr(10), source) AS text FROM {SEEDED} s)"


@query("d18_tool_response_scan", f"""
SELECT doc_id AS msg_no, detector, type, value, 'mcp.response.content' AS location FROM {hits_sql(SECRETS, _RESP)} h
UNION ALL SELECT doc_id, detector, type, value, 'mcp.response.content' FROM {hits_sql(INJ, _RESP, first_only=True)} h""")
def _d18(spark, sf):
    t = tooling.response_texts(tooling.parse_messages(_responses(spark, sf)))
    return tooling.scan_responses(t, RULES).select("msg_no", "detector", "type", "value", "location")


@query("d16_response_scan", f"""
SELECT doc_id, detector, type, value, 'response.response.content' AS location FROM {hits_sql(SECRETS, SEEDED)} h
UNION ALL SELECT doc_id, detector, type, value, 'response.content' FROM {hits_sql(INJ, SEEDED, first_only=True)} h""")
def _d16(spark, sf):
    return tooling.scan_responses(seeded(spark, sf).select("doc_id", "text"), RULES, "response.", ["doc_id"]).select("doc_id", "detector", "type", "value", "location")


@query("d20_frame_scan", f"""
WITH h AS {hits_sql(SECRETS, SEEDED)}, i AS {hits_sql(INJ, SEEDED, first_only=True)}
SELECT doc_id AS frame_id, detector, type, value, CASE doc_id % 2 WHEN 0 THEN 'ws.inbound.ws.inbound' ELSE 'ws.outbound.ws.outbound' END AS location FROM h
UNION ALL SELECT doc_id, detector, type, value, 'ws.inbound' FROM i WHERE doc_id % 2 = 0""")
def _d20(spark, sf):
    return tooling.scan_frames(_frames(spark, sf), RULES).select("frame_id", "detector", "type", "value", "location")


def _frames(spark, sf):
    return seeded(spark, sf).select(F.col("doc_id").alias("frame_id"), F.expr("if(doc_id % 2 = 0, 'inbound', 'outbound')").alias("direction"), "text")


@query("s16_frame_log", f"SELECT CASE doc_id % 2 WHEN 0 THEN 'inbound' ELSE 'outbound' END AS direction, count(*) AS frames, CAST(sum(length(text)) AS BIGINT) AS chars FROM {SEEDED} s GROUP BY 1")
def _s16(spark, sf):
    return _frames(spark, sf).groupBy("direction").agg(F.count("*").alias("frames"), F.sum(F.length("text")).alias("chars"))


@query("f08_tool_lists", f"SELECT event_id AS msg_no, {_TOOLNAME} AS tool_name, k % 12 IN (1, 2, 3) AS allowed FROM {_E} e WHERE {_KIND} = 'call'")
def _f08(spark, sf):
    from dredgeline.operators.filters import tool_allowed

    c = tooling.tool_calls(tooling.parse_messages(_messages(spark, sf)))
    return c.select("msg_no", "tool_name", tool_allowed("tool_name", ["tool_1", "tool_2", "tool_3", "tool_4"], ["tool_4", "tool_9"]).alias("allowed"))


_EMAIL = [r for r in RULES if r.name == "email"]


@query("d17_tool_argument_scan", f"""
SELECT event_id AS msg_no, CASE WHEN k % 12 = 4 THEN 'blocked_tool' ELSE 'email' END AS type, CASE WHEN k % 12 = 4 THEN 'tool_4' ELSE concat('user', CAST(user_id AS STRING), '@example.com') END AS value,
 CASE WHEN k % 12 = 4 THEN 'mcp.tools/call.tool_4' ELSE concat('mcp.tools/call.', {_TOOLNAME}, '.arguments') END AS location FROM {_E} e WHERE {_KIND} = 'call'""")
def _d17(spark, sf):
    c = tooling.tool_calls(tooling.parse_messages(_messages(spark, sf)))
    return tooling.scan_arguments(c, _EMAIL, blocked=["tool_4"]).select("msg_no", "type", "value", "location")


_LISTS = f"(SELECT event_id AS msg_no, ts, user_id, k, [concat('tool_', CAST(k % 12 AS STRING)), concat('tool_', CAST((k + 1) % 12 AS STRING)), concat('tool_', CAST((k + 2) % 12 AS STRING))] AS names FROM {_E} e WHERE {_KIND} = 'list')"
_INV = f"(SELECT user_id, arg_min(names, msg_no) AS known_tools, min(msg_no) AS bound FROM {_LISTS} l GROUP BY 1)"


@query("j10_session_binding", f"""
SELECT e.event_id AS msg_no, {_TOOLNAME} AS tool_name, coalesce(NOT (e.event_id > bound) OR list_contains(known_tools, {_TOOLNAME}), true) AS known FROM {_E} e LEFT JOIN {_INV} i USING (user_id) WHERE {_KIND} = 'call'""")
def _j10(spark, sf):
    m = tooling.parse_messages(_messages(spark, sf))
    return tooling.bind_calls(tooling.tool_calls(m), tooling.tool_lists(m)).select("msg_no", "tool_name", "known")


@query("u02_late_tools", f"SELECT l.msg_no, array_to_string(list_sort(list_filter(names, lambda x: NOT list_contains(known_tools, x))), ',') AS added FROM {_LISTS} l JOIN {_INV} i USING (user_id) WHERE l.msg_no > bound AND NOT list_has_all(known_tools, names)")
def _u02(spark, sf):
    l = tooling.tool_lists(tooling.parse_messages(_messages(spark, sf)))
    return tooling.late_tools(l).select("msg_no", F.array_join("added", ",").alias("added"))


@query("w05_first_version", f"SELECT concat('s', CAST(user_id AS STRING)) AS session_id, array_to_string(known_tools, ',') AS tools FROM {_INV} i")
def _w05(spark, sf):
    l = tooling.tool_lists(tooling.parse_messages(_messages(spark, sf)))
    return tooling.session_inventory(l).select("session_id", F.array_join("known_tools", ",").alias("tools"))


@query("l18_tool_call_verdict", f"""
WITH b AS (SELECT e.event_id AS msg_no, k, event_type, coalesce(NOT (e.event_id > bound) OR list_contains(known_tools, {_TOOLNAME}), true) AS known FROM {_E} e LEFT JOIN {_INV} i USING (user_id) WHERE {_KIND} = 'call')
SELECT msg_no, CASE WHEN event_type = 'error' THEN 'blocked' WHEN k % 12 = 4 THEN 'blocked' ELSE 'alerted' END AS status, CAST(1 AS BIGINT) AS finding_count FROM b""")
def _l18(spark, sf):
    m = tooling.parse_messages(_messages(spark, sf))
    calls = tooling.bind_calls(tooling.tool_calls(m), tooling.tool_lists(m))
    found = tooling.scan_arguments(calls, _EMAIL, blocked=["tool_4"])
    pol = F.when(F.col("event_type") == "error", "block")
    return tooling.call_verdicts(calls, found, "warn", pol).select("msg_no", "status", "finding_count")


_DIR = "CASE WHEN event_id % 3 = 0 THEN 'out' ELSE 'in' END"
_MID = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN concat('\"', CAST(k % 4 AS STRING), '\"') ELSE CAST(k % 4 AS STRING) END"
_J9 = f"""
WITH m AS (SELECT event_id AS msg_no, ts, user_id, {_DIR} AS direction, {_MID} AS msg_id FROM {_E} e),
g AS (SELECT user_id, min(msg_no) AS begun FROM m WHERE direction = 'out' AND msg_id IS NOT NULL GROUP BY 1),
w AS (SELECT *, lag(direction) OVER (PARTITION BY user_id, msg_id ORDER BY ts, msg_no) AS before FROM m WHERE msg_id IS NOT NULL)
SELECT msg_no, msg_id, begun IS NULL OR msg_no < begun OR coalesce(before = 'out', false) AS valid FROM w LEFT JOIN g USING (user_id) WHERE direction = 'in'
UNION ALL SELECT msg_no, msg_id, true FROM m WHERE msg_id IS NULL AND direction = 'in'"""


def _exchange(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    return e.select(F.col("event_id").alias("msg_no"), "ts", F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(_DIR).alias("direction"), F.expr(_MID.replace('\\"', '"')).alias("msg_id"))


@query("j09_unsolicited_responses", _J9)
def _j09(spark, sf):
    return tooling.unsolicited(_exchange(spark, sf)).select("msg_no", "msg_id", "valid")


# Drift: parts are tools; the baseline is the same catalogue with some definitions changed.


@query("j03_tool_drift", """
SELECT p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'drifted' WHEN 3 THEN 'drifted' ELSE 'absent' END AS state,
 CASE p_partkey % 5 WHEN 2 THEN concat('Tool "', CAST(p_partkey AS STRING), '" definition changed:', chr(10), '  description: ', CAST(length(p_name) AS STRING), ' -> ', CAST(length(p_name) + 9 AS STRING), ' chars (+9)', chr(10), '  added: " now evil"')
   WHEN 3 THEN concat('Tool "', CAST(p_partkey AS STRING), '" definition changed:', chr(10), '  parameters added: ["c"]', chr(10), '  parameters removed: ["b"]') ELSE '' END AS summary,
 CASE WHEN p_partkey % 5 IN (2, 3) THEN 3 WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS drift_count FROM part""")
def _j03(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_partkey") % 5).alias("m"), F.col("p_name").alias("description"))
    old = F.lit('{"type":"object","properties":{"a":{},"b":{}}}')
    base = p.where("m <> 0").select("name", tooling.definition_hash(F.col("description"), old).alias("definition_hash"), "description", tooling.parameter_names(old).alias("param_names"), F.lit(2).alias("drift_count"))
    cur = p.where("m <> 4").select("name", F.when(F.col("m") == 2, F.concat("description", F.lit(" now evil"))).otherwise(F.col("description")).alias("description"),
                                  F.when(F.col("m") == 3, '{"properties":{"a":{},"c":{}},"type":"object"}').otherwise('{"properties": {"b": {}, "a": {}}, "type": "object"}').alias("input_schema"))
    return tooling.tool_drift(cur, base).select(F.col("name").cast("bigint").alias("name"), "state", "summary", "drift_count")


# ---- plug-ins ------------------------------------------------------------------------------------------
@query("x01_extra_detector", f"SELECT type, count(*) AS n FROM (SELECT type FROM {hits_sql(_EMAIL, SEEDED)} h UNION ALL SELECT 'question' FROM {SEEDED} s WHERE contains(text, '?') OR contains(text, 'curl')) x GROUP BY 1")
def _x01(spark, sf):
    def question(fields):
        hit = fields.where(F.contains("text", F.lit("?")) | F.contains("text", F.lit("curl")))
        return hit.select("doc_id", "field_no", "variant", F.lit("extra").alias("detector"), F.lit("question").alias("type"), F.lit("info").alias("severity"), F.lit("").alias("action"),
                          F.col("path").alias("location"), F.lit("?").alias("value"), F.lit("?").alias("value_preview"), F.lit(9999).alias("rule_no"), F.lit(0).alias("match_no"))

    plug = Plugins()
    plug.add_detector(question)
    x = seeded(spark, sf).select("doc_id", F.lit(0).alias("field_no"), F.array().cast("array<int>").alias("variant"), F.lit("t").alias("path"), "text", F.lit("").alias("source_filename"))
    return jobs._detect(x, ["doc_id"], jobs.ScanConfig(rules=_EMAIL, detect_proprietary=False, plugins=plug)).groupBy("type").agg(F.count("*").alias("n"))


@query("x02_named_validator", f"SELECT doc_id, value FROM {hits_sql(_EMAIL, SEEDED)} h WHERE length(value) % 2 = 0")
def _x02(spark, sf):
    Plugins().add_validator("even_length", lambda v: F.length(v) % 2 == 0)
    rule = detect.Rule("even_email", _EMAIL[0].pattern, "pii", validator="even_length")
    return seeded_findings(spark, sf, [rule]).select("doc_id", "value")


@query("x03_evaluate_hook", f"SELECT doc_id AS req_id, CASE WHEN count(DISTINCT type) > 1 THEN 'block' ELSE 'alert' END AS action FROM {hits_sql(RULES, 'documents')} h GROUP BY 1")
def _x03(spark, sf):
    """A hook that blocks requests with findings of more than one type and leaves the rest to the default."""
    found = detect.scan(docs(spark, sf), RULES, keep=["doc_id"]).withColumnRenamed("doc_id", "req_id")

    def evaluate(f, default):
        several = f.groupBy("req_id").agg((F.count_distinct("type") > 1).alias("several"))
        return default(f).join(several, "req_id").withColumn("action", F.when(F.col("several"), "block").otherwise(F.col("action")))

    return Plugins(evaluate=evaluate).run_evaluate(found, lambda f: f.groupBy("req_id").agg(F.lit("alert").alias("action"))).select("req_id", "action")


@query("x09_session_escalation", with_findings("""
SELECT session_id, CAST(greatest(sum(CASE detector WHEN 'secrets' THEN 3.0 WHEN 'pii' THEN 2.0 WHEN 'custom' THEN -0.5 ELSE 0.0 END), 0.0) AS DOUBLE) AS score FROM f GROUP BY 1"""))
def _x09(spark, sf):
    s = findings(spark, sf).withColumn("signal", F.expr("CASE detector WHEN 'secrets' THEN 'block' WHEN 'pii' THEN 'unknown_tool' WHEN 'custom' THEN 'clean' ELSE 'none' END"))
    return tooling.escalation(s).select("session_id", F.col("score").cast("double").alias("score"))


@query("x04_redact_hook", f"SELECT doc_id, md5(regexp_replace(text, 'AKIA[0-9A-Z]{{16}}', '<aws_access_key of 20>', 'g')) AS md5 FROM {SEEDED} s")
def _x04(spark, sf):
    """A hook that puts the type and the length of a value in its place."""
    def tagged(texts, found, default):
        marks = found.where("action = 'redact'").groupBy("doc_id").agg(F.collect_set(F.struct("value", "type")).alias("marks"))
        mark = lambda acc, m: F.replace(acc, m["value"], F.concat(F.lit("<"), m["type"], F.lit(" of "), F.length(m["value"]).cast("string"), F.lit(">")))
        new = F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.aggregate("marks", F.col("text"), mark))
        return texts.join(marks, "doc_id", "left").withColumn("text", new)

    found = seeded_findings(spark, sf, [r for r in RULES if r.name == "aws_access_key"]).withColumn("action", F.lit("redact"))
    return jobs.redact_texts(seeded(spark, sf).select("doc_id", "text"), found, jobs.ScanConfig(plugins=Plugins(redact=tagged)), ["doc_id"]).select("doc_id", md5())


@query("x05_post_scan_hook", f"SELECT type, count(*) AS requests FROM (SELECT DISTINCT doc_id, type FROM {hits_sql(RULES, 'documents')} h) x GROUP BY 1")
def _x05(spark, sf):
    """A hook that keeps a table of the types it has seen; a second one that fails is reported and stops nothing."""
    path = f"{work_dir(spark, 'x05')}/seen"
    plug = Plugins(post_scan=[lambda results: 1 / 0, lambda results: results.groupBy("type").agg(F.count_distinct("doc_id").alias("requests")).write.parquet(path)])
    jobs.finish(detect.scan(docs(spark, sf), RULES, keep=["doc_id"]), jobs.ScanConfig(plugins=plug))
    if [f.hook for f in plug.failures] != ["post_scan"]:
        raise RuntimeError(f"hooks failed: {plug.failures}")
    return spark.read.parquet(path)


@query("x06_response_filter_hook", f"""
SELECT doc_id, detector, type, value FROM {hits_sql(SECRETS, SEEDED)} h WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, detector, type, value FROM {hits_sql(INJ, SEEDED, first_only=True)} h WHERE doc_id % 3 <> 0""")
def _x06(spark, sf):
    """A hook that lets some responses pass unscanned."""
    plug = Plugins(response_filter=lambda texts: texts.where("doc_id % 3 <> 0"))
    found = jobs.scan_response_texts(seeded(spark, sf).select("doc_id", "text"), jobs.ScanConfig(rules=RULES, plugins=plug), keep=["doc_id"])
    return found.select("doc_id", "detector", "type", "value")


def _chunk_stream(spark, sf, name, build):
    """Documents as responses in chunks of 150 characters, which arrive out of order and in turns."""
    t = seeded(spark, sf).select(F.col("doc_id").alias("response_id"), F.expr("regexp_extract_all(concat(text, ' '), '(?s).{1,150}', 0)").alias("parts"))
    chunks = t.select("response_id", F.size("parts").alias("n"), F.posexplode("parts").alias("chunk_no", "text"))
    chunks = chunks.select("response_id", "chunk_no", "text", (F.col("chunk_no") == F.col("n") - 1).alias("last"))
    turn = F.pmod(F.floor(F.col("chunk_no") / 2) + F.col("response_id"), F.lit(TURNS))
    start = lambda stream, base: batches.response_pieces(stream, f"{base}/t", f"{base}/c", build, keep_ms=None)
    return batches.read_out(spark, f"{_in_turns(spark, chunks, turn, name, start)}/t")


@query("x06_response_chunk_scan", f"SELECT DISTINCT doc_id AS response_id, type, sha256(value) AS value_hash FROM {HITS}")
def _x06b(spark, sf):
    found = _chunk_stream(spark, sf, "x06b", lambda p: chunking.scan_pieces(p, RULES).select("response_id", "type", F.sha2("value", 256).alias("value_hash")))
    return found.distinct()


@query("x06_response_chunk_hook", f"SELECT doc_id AS response_id, md5(regexp_replace(concat(text, ' '), 'AKIA[0-9A-Z]{{16}}', '<key>', 'g')) AS md5 FROM {SEEDED} s")
def _x06c(spark, sf):
    """A hook that rewrites what is passed on; a key that lies across two chunks is rewritten whole."""
    plug = Plugins(response_chunk=lambda pieces: pieces.withColumn("text", F.regexp_replace("text", "AKIA[0-9A-Z]{16}", "<key>")))
    out = _chunk_stream(spark, sf, "x06c", lambda p: plug.run_response_chunk(chunking.owned(p)).select("response_id", "chunk_no", "text"))
    whole = files.assemble_chunks(out)
    return whole.select("response_id", md5())


@query("x08_tool_policy_hook", f"""
SELECT e.event_id AS msg_no, CASE WHEN event_type = 'error' THEN 'blocked' WHEN k % 12 = 4 THEN 'blocked' WHEN event_type = 'view' THEN 'alerted'
  WHEN NOT coalesce(NOT (e.event_id > bound) OR list_contains(known_tools, {_TOOLNAME}), true) THEN 'alerted' WHEN n > 0 THEN 'alerted' ELSE 'allowed' END AS status
FROM {_E} e LEFT JOIN {_INV} i USING (user_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM {hits_sql(SECRETS, '(SELECT event_id AS doc_id, to_json(event_type) AS text FROM events)')} h GROUP BY 1) f ON f.doc_id = e.event_id WHERE {_KIND} = 'call'""")
def _x08(spark, sf):
    """An evaluator that blocks calls of one kind of event and flags those of another."""
    m = tooling.parse_messages(_messages(spark, sf))
    calls = tooling.bind_calls(tooling.tool_calls(m), tooling.tool_lists(m)).withColumn("arguments", F.to_json(F.struct(F.col("event_type").alias("q"))))
    plug = Plugins(tool_policy=lambda c: F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "view", "alert"))
    found = tooling.scan_arguments(calls, SECRETS, blocked=["tool_4"])
    return jobs.tool_call_verdicts(calls, found, jobs.ScanConfig(plugins=plug)).select("msg_no", "status")


@query("x10_extra_clients", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'aider' WHEN 2 THEN CASE WHEN event_id % 7 = 1 THEN 'opencode' ELSE concat('ai-sdk/openai/3.', CAST(user_id AS STRING)) END
   WHEN 3 THEN 'copilot' WHEN 4 THEN 'my_tool' ELSE '' END AS client_id, CASE WHEN event_id % 6 = 4 THEN 'My Tool' END AS mine FROM events""")
def _x10(spark, sf):
    """A client of the caller's own; it does not take the place of a built-in one."""
    plug = Plugins()
    plug.register_clients([("my_tool", "My Tool", "cli", "multi", ("mytool/",)), ("mine_too", "x", "cli", "multi", ("aider/",))])
    c = jobs.client_columns(_requests(spark, sf), jobs.ScanConfig(plugins=plug))
    return c.select("event_id", "client_id", F.when(F.col("client_display") == "My Tool", F.col("client_display")).alias("mine"))


@query("x10_channel_types", with_findings("SELECT 'pager' AS channel_type, severity, count(*) AS n FROM f WHERE severity = 'critical' GROUP BY 2 UNION ALL SELECT 'digest', severity, count(*) FROM f WHERE severity IN ('high', 'critical') AND action_taken = 'block' GROUP BY 2"))
def _x10b(spark, sf):
    """Senders of two channel types that file what they are sent; a third type has no sender, which is reported."""
    base = work_dir(spark, "x10")
    channels = spark.sql("SELECT * FROM VALUES ('a', 'pager', array(), 'critical'), ('b', 'digest', array('block'), 'high'), ('c', 'fax', array('log'), 'info') AS t(channel_id, channel_type, events, min_severity)")
    channels = channels.withColumn("events", F.col("events").cast("array<string>"))
    alerts = governance.route_alerts(findings(spark, sf).withColumn("action", F.col("action_taken")), channels.drop("channel_type")).join(F.broadcast(channels.select("channel_id", "channel_type")), "channel_id")
    send = lambda name: lambda rows: rows.groupBy("channel_type", "severity").agg(F.count("*").alias("n")).write.parquet(f"{base}/{name}")
    plug = Plugins(channel_types={name: send(name) for name in ("pager", "digest")})
    served = plug.run_channels(alerts)
    if [f.hook for f in plug.failures] != ["channel fax"]:
        raise RuntimeError(f"hooks failed: {plug.failures}")
    return spark.read.parquet(*(f"{base}/{name}" for name in served))


# ---- streams --------------------------------------------------------------------------------------------------
def _stream(spark, sf, name):
    """A given table as a file stream, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")  # a pattern, as a plain path has to be a folder


TURNS = 5


@contextmanager
def _state_store(spark):
    """Keyed streams keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _in_turns(spark, rows, turn, name, start):
    """Rows arrive in turns: after each, ``start(stream, folder)`` takes up the stream where it stopped. The folder."""
    base, schema = work_dir(spark, name), rows.schema
    with _state_store(spark):
        for k in range(TURNS):
            rows.where(turn == k).write.mode("append").parquet(f"{base}/in")
            start(spark.readStream.schema(schema).parquet(f"{base}/in"), base).awaitTermination()
    return base


def _by_time(events):
    """The events' turns: fifths of the time they cover."""
    least, most = events.agg(F.min("ts"), F.max("ts")).first()
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (least, most))
    return F.least(F.lit(TURNS - 1), F.floor((us - lo) * TURNS / F.greatest(hi - lo, F.lit(1)))).cast("int")


def _drain(spark, df, name, mode="append"):
    """Run a stream over everything available and read its sink."""
    base = work_dir(spark, name)
    with _state_store(spark):
        _to_files(df, base, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/t")


def _to_files(df, base, mode="append"):
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(f"{base}/t")


def _event_batches(spark, sf, name, operator, build):
    """What ``operator(stream, folder, checkpoint)`` puts out for ``build(events)`` in turns, its state carried from one to the next."""
    events = table(spark, sf, "events")
    base = _in_turns(spark, events, _by_time(events), name, lambda stream, base: operator(build(stream), f"{base}/t", f"{base}/c"))
    return batches.read_out(spark, f"{base}/t")


def _stream_findings(events):
    from dredgeline.plans.registry import _FINDINGS

    return events.sparkSession.sql(_FINDINGS.format(events="{e}"), e=events)


def _keyed(events):
    f = _stream_findings(events)
    return f.select("id", F.col("timestamp").cast("timestamp").alias("ts"), "detector", F.col("event_type").alias("type"), F.sha2("value", 256).alias("value_hash"), "session_id")


@query("r01_streaming_scan", f"SELECT doc_id, type, sha256(value) AS value_hash FROM {hits_sql(RULES, 'documents')} h")
def _r01(spark, sf):
    s = detect.scan(_stream(spark, sf, "documents"), RULES, keep=["doc_id"]).select("doc_id", "type", F.sha2("value", 256).alias("value_hash"))
    return _drain(spark, s, "r01")


@query("r02_streaming_finding_ttl", with_more(_TTL_SQL.format(ttl=86400)))
def _r02(spark, sf):
    return _event_batches(spark, sf, "r02", partial(batches.finding_ttl, ttl_seconds=86400), _keyed).select("id")


@query("r03_streaming_text_dedup", with_more("""
, q AS (SELECT id, session_id, timestamp AS ts, k, action_taken AS action, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id) > INTERVAL 40000 SECOND THEN 1 ELSE 0 END AS nw FROM f WHERE session_id <> ''),
e AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY ts, id) AS ep FROM q),
c AS (SELECT session_id, ep, k, min((ts, id)) AS first FROM e WHERE action NOT IN ('block', 'redact') OR (action = 'block' AND k % 4 = 0) GROUP BY ALL)
SELECT id AS req_id, coalesce(c.first < (e.ts, e.id), false) AS skipped FROM e LEFT JOIN c ON c.session_id = e.session_id AND c.ep = e.ep AND c.k = e.k"""))
def _r03(spark, sf):
    def build(events):
        f = _stream_findings(events).select(F.col("id").alias("req_id"), F.col("timestamp").cast("timestamp").alias("ts"), "session_id", F.lit(0).alias("field_no"),
                                            F.sha2(F.concat(F.lit("b"), F.col("k").cast("string")), 256).alias("text_hash"), F.col("action_taken").alias("action"), (F.col("k") % 4 == 0).alias("stripped"))
        return f.where("session_id <> ''")

    return _event_batches(spark, sf, "r03", partial(batches.text_dedup, ttl_seconds=40000), build).select("req_id", "skipped")


@query("r04_streaming_upsert", with_findings("SELECT session_id, count(*) AS rows, CAST(sum(n) AS BIGINT) AS seen FROM (SELECT session_id, detector, finding_type, value, count(*) AS n FROM f WHERE session_id <> '' GROUP BY ALL) x GROUP BY 1"))
def _r04(spark, sf):
    from dredgeline.sources.stores import read_findings

    def start(events, base):
        return state.upsert_stream(_stream_findings(events).withColumnRenamed("finding_type", "type"), f"{base}/t", f"{base}/c", b"pepper")

    events = table(spark, sf, "events")
    base = _in_turns(spark, events, _by_time(events), "r04", start)
    return read_findings(spark, f"{base}/t").where("session_id <> ''").groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("seen_count").alias("seen"))


@query("r05_streaming_unsolicited", _J9)
def _r05(spark, sf):
    def build(events):
        e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
        return e.select(F.col("event_id").alias("msg_no"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(_DIR).alias("direction"), F.expr(_MID).alias("msg_id"))

    return _event_batches(spark, sf, "r05", batches.unsolicited, build).select("msg_no", "msg_id", "valid")


@query("r05_streaming_tool_binding", f"""
SELECT e.event_id AS msg_no, coalesce(NOT (e.event_id > bound) OR list_contains(known_tools, {_TOOLNAME}), true) AS known FROM {_E} e LEFT JOIN {_INV} i USING (user_id) WHERE {_KIND} = 'call'""")
def _r05b(spark, sf):
    def build(events):
        e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
        return e.where(F.expr(_KIND) != "other").select(
            F.col("event_id").alias("msg_no"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr(_KIND).alias("kind"), F.expr(_TOOLNAME).alias("tool_name"),
            F.expr("if(event_id % 5 = 0, transform(array(0, 1, 2), j -> concat('tool_', (k + j) % 12)), cast(array() as array<string>))").alias("tool_names"))

    return _event_batches(spark, sf, "r05b", batches.tool_binding, build).select("msg_no", "known")


@query("r06_live_counters", with_findings("SELECT strftime(date_trunc('minute', timestamp), '%Y-%m-%d %H:%M') AS minute, event_type AS type, count(*) AS hits FROM f GROUP BY 1, 2"))
def _r06(spark, sf):
    s = _stream_findings(_stream(spark, sf, "events")).select(F.col("timestamp").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    base, name = work_dir(spark, "r06"), "r06_live_counters"
    counts = state.live_counters(s)

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/t/b={batch_id}")

    with _state_store(spark):
        counts.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{base}/c").queryName(name).trigger(availableNow=True).start().awaitTermination()
    # Update mode: the last batch that carries a window holds its final count.
    out = spark.read.parquet(f"{base}/t").groupBy("window_start", "type").agg(F.max_by("hits", "b").alias("hits"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "type", "hits")


@query("r07_live_event_feed", f"SELECT 'finding' AS event, doc_id AS req_id, type, severity FROM {hits_sql(RULES, 'documents')} h")
def _r07(spark, sf):
    s = detect.scan(_stream(spark, sf, "documents").withColumnRenamed("doc_id", "req_id"), RULES, keep=["req_id"])
    return _drain(spark, state.finding_events(s).select("event", "req_id", "type", "severity"), "r07")


@query("r08_response_assembly", "SELECT doc_id AS response_id, md5(text) AS md5 FROM documents")
def _r08(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_id").alias("response_id"), F.posexplode(F.expr("regexp_extract_all(text, '(?s).{1,400}', 0)")).alias("chunk_no", "text"))
    c = files.assemble_chunks(chunks)
    d = docs(spark, sf).select(F.col("doc_id").alias("response_id")).join(c, "response_id", "left")
    return d.select("response_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
