"""Text preparation, field extraction and identity over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dredgeline.functions import text as tx
from dredgeline.operators import extract, identity, textprep
from dredgeline.plans.registry import LINES_SQL, docs, jstr, md5, query, spread, table
from dredgeline.sources import files

_ZW = "[\\x{200B}-\\x{200F}\\x{2028}-\\x{202E}\\x{2060}\\x{FEFF}]"


@query("t01_zero_width_strip",
       f"SELECT doc_id, md5(regexp_replace(replace(text, ' ', concat(' ', chr(8203))), '{_ZW}', '', 'g')) AS md5 FROM documents")
def _t01(spark, sf):
    d = docs(spark, sf).select("doc_id", F.replace("text", F.lit(" "), F.lit(" \N{ZERO WIDTH SPACE}")).alias("text"))
    return d.select("doc_id", F.md5(tx.strip_zero_width("text")).alias("md5"))


@query("t02_nfkc", "SELECT doc_id, md5(text) AS md5 FROM documents")
def _t02(spark, sf):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "abcABC019")
    d = docs(spark, sf).select("doc_id", F.translate("text", "abcABC019", wide).alias("text"))
    return textprep.sanitize_frame(d).select("doc_id", md5())


_PAYLOAD = "concat('contact user', CAST(doc_id AS STRING), '@example.com about ', source)"


@query("t03_base64_segments", f"SELECT doc_id, {_PAYLOAD} AS decoded FROM documents")
def _t03(spark, sf):
    d = docs(spark, sf).withColumn("text", F.expr(f"concat(text, ' ', base64(encode({_PAYLOAD}, 'UTF-8')))"))
    return d.select("doc_id", F.explode(F.expr(tx.base64_texts_sql("text"))).alias("decoded")).where(F.contains("decoded", F.lit("@example.com")))


@query("t04_hex_segments", f"SELECT doc_id, {_PAYLOAD} AS decoded FROM documents")
def _t04(spark, sf):
    d = docs(spark, sf).withColumn("text", F.expr(f"concat(text, ' ', lower(hex(encode({_PAYLOAD}, 'UTF-8'))))"))
    return d.select("doc_id", F.explode(F.expr(tx.hex_texts_sql("text"))).alias("decoded")).where(F.contains("decoded", F.lit("@example.com")))


_RATIO = "length(regexp_replace(text, '[^ -~]', '', 'g')) / length(text)"
_WHOLE = f"SELECT doc_id, md5(text) AS md5 FROM documents WHERE length(text) >= 8 AND {_RATIO} >= 0.7"


def _whole(df, encoding):
    on = {"base64": False, "hexa": False, "url": encoding == "url", "esc": encoding == "unicode"}
    out = textprep.decode_fields(df, path=None, max_depth=1, sanitize_decoded=False, **on)
    return out.where(F.col("encoding") == encoding).select("doc_id", md5())


@query("t05_url_decode", _WHOLE + " AND contains(text, ' ')")
def _t05(spark, sf):
    return _whole(docs(spark, sf).select("doc_id", F.replace("text", F.lit(" "), F.lit("%20")).alias("text")), "url")


@query("t06_unicode_decode", _WHOLE + " AND contains(text, 'on')")
def _t06(spark, sf):
    return _whole(docs(spark, sf).select("doc_id", F.replace("text", F.lit("on"), F.lit("\\u006f\\u006e")).alias("text")), "unicode")


_INNER = "concat('user%40host', CAST(doc_id AS STRING), '.example.org says hello')"
_B64 = f"to_base64(encode({_INNER}))"


@query("t07_recursive_decode", f"""
WITH x AS (SELECT doc_id, concat(text, ' ', {_B64}) AS text, {_INNER} AS inner_text FROM documents)
SELECT doc_id, 0 AS depth, 'raw' AS encoding, 'body' AS path, md5(text) AS md5 FROM x
UNION ALL SELECT doc_id, 1, 'base64', 'body[base64]', md5(inner_text) FROM x
UNION ALL SELECT doc_id, 2, 'url', 'body[url]', md5(replace(inner_text, '%40', '@')) FROM x""")
def _t07(spark, sf):
    d = docs(spark, sf).select("doc_id", F.lit("body").alias("path"), F.expr(f"concat(text, ' ', base64(encode({_INNER}, 'UTF-8')))").alias("text"))
    v = textprep.decode_fields(d).where((F.col("encoding") == "raw") | F.col("text").rlike(r"example\.org"))
    return v.select("doc_id", F.size("variant").alias("depth"), "encoding", "path", md5())


@query("t08_meaningful", f"SELECT doc_id, round({_RATIO}, 6) AS printable, {_RATIO} >= 0.7 AND length(text) >= 8 AS meaningful FROM documents WHERE length(text) > 0")
def _t08(spark, sf):
    d = docs(spark, sf).where(F.length("text") > 0)
    ratio = F.length(F.regexp_replace("text", "[^ -~]", "")) / F.length("text")
    return d.select("doc_id", F.round(ratio, 6).alias("printable"), tx.meaningful("text").alias("meaningful"))


@query("t09_decoded_cap", "SELECT doc_id, CAST(least(length(text), 10000) AS BIGINT) AS n FROM documents")
def _t09(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(textprep.cap("text", 10_000)).cast("bigint").alias("n"))


@query("t10_text_budget", f"""
WITH x AS (SELECT doc_id, k, line, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS upto
           FROM {LINES_SQL} q WHERE line <> ''),
y AS (SELECT *, upto - length(line) AS s FROM x)
SELECT doc_id, concat('lines[', CAST(k AS STRING), ']') AS path,
  md5(CASE WHEN upto <= 3000 THEN line ELSE substr(line, 1, CAST(3000 - s AS BIGINT)) END) AS md5
FROM y WHERE upto <= 3000 OR (s <= 3000 AND 3000 - s > 100)""")
def _t10(spark, sf):
    lines = "filter(transform(split(text, '\\n'), (l, i) -> struct(concat('lines[', i, ']') as path, l as text, '' as source_filename)), f -> f.text <> '')"
    d = docs(spark, sf).withColumn("fields", F.expr(lines)).withColumn("fields", textprep.text_budget("fields", 3000))
    return extract.explode_fields(d.select("doc_id", "fields")).select("doc_id", "path", md5())


@query("t10_text_budget_rows", """
WITH x AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM conversations),
y AS (SELECT *, upto - length(text) AS s FROM x)
SELECT conv_id, turn, md5(CASE WHEN upto <= 2000 THEN text ELSE substr(text, 1, CAST(2000 - s AS BIGINT)) END) AS md5
FROM y WHERE upto <= 2000 OR (s <= 2000 AND 2000 - s > 100)""")
def _t10b(spark, sf):
    c = table(spark, sf, "conversations")
    return textprep.text_budget_rows(c, ["conv_id"], "turn", "text", 2000).select("conv_id", "turn", md5())


@query("t11_size_caps", "SELECT page_id, md5(substr(html, 1, 4096)) AS md5, octet_length(encode(html)) > 8192 AS oversized FROM pages")
def _t11(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select("page_id", F.md5(textprep.cap("html", 4096)).alias("md5"), textprep.oversized("html", 8192).alias("oversized"))


# ---- request bodies built from whole documents ---------------------------------------------------
_LINES = "split(text, '\\n')"


def body_a(df):
    msg = (
        "CASE i % 3 WHEN 0 THEN concat('{\"role\":\"user\",\"content\":', " + jstr("l") + ", '}') "
        "WHEN 1 THEN concat('{\"role\":\"assistant\",\"content\":[{\"type\":\"text\",\"text\":', " + jstr("l") + ", '},{\"type\":\"image\"}]}') "
        "ELSE concat('{\"role\":\"user\",\"content\":[{\"type\":\"tool_result\",\"input\":{\"file_path\":\"\",\"path\":\"src/f', i, '.key\"},\"content\":', "
        + jstr("l") + ", '}]}') END"
    )
    body = f"concat('{{\"system\":', {jstr('_l[0]')}, ',\"messages\":[', array_join(transform(slice(_l, 2, size(_l)), (l, i) -> {msg}), ','), ']}}')"
    return df.withColumn("_l", F.expr(_LINES)).withColumn("body", F.expr(body)).drop("_l")


def body_o(df):
    msg = (
        "CASE i % 3 WHEN 0 THEN concat('{\"role\":\"user\",\"content\":[{\"type\":\"text\",\"text\":', " + jstr("l") + ", '}]}') "
        "WHEN 1 THEN concat('{\"role\":\"tool\",\"content\":', " + jstr("l") + ", '}') "
        "ELSE concat('{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{\"function\":{\"arguments\":', "
        + jstr("concat('{\"n\":1,\"q\":', " + jstr("l") + ", '}')") + ", '}}]}') END"
    )
    body = f"concat('{{\"user\":\"u', doc_id, '\",\"messages\":[', array_join(transform(_l, (l, i) -> {msg}), ','), ']}}')"
    return df.withColumn("_l", F.expr(_LINES)).withColumn("body", F.expr(body)).drop("_l")


def body_g(df):
    part = (
        "CASE i % 3 WHEN 0 THEN concat('{\"text\":', " + jstr("l") + ", '}') "
        "WHEN 1 THEN concat('{\"functionResponse\":{\"response\":{\"a\":{\"b\":[1,', " + jstr("l") + ", ']}}}}') "
        "ELSE concat('{\"functionCall\":{\"args\":{\"q\":', " + jstr("l") + ", ',\"n\":null}}}') END"
    )
    body = f"concat('{{\"contents\":[{{\"parts\":[', array_join(transform(_l, (l, i) -> {part}), ','), ']}}]}}')"
    return df.withColumn("_l", F.expr(_LINES)).withColumn("body", F.expr(body)).drop("_l")


def body_generic(df):
    body = f"concat('{{\"meta\":{{\"lang\":', {jstr('lang')}, ',\"n\":', n_chars, '}},\"rows\":[', array_join(transform(_l, l -> concat('{{\"t\":', {jstr('l')}, '}}')), ','), ']}}')"
    return df.withColumn("_l", F.expr(_LINES)).withColumn("body", F.expr(body)).drop("_l")


def _fields(df):
    return extract.extract_fields(df.select("doc_id", "body")).select("doc_id", "path", md5(), "source_filename")


_N = "CAST(k AS STRING)"
_N1 = "CAST(k - 1 AS STRING)"


@query("e01_format_detect", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'o' WHEN 2 THEN 'g' ELSE 'generic' END AS wire_format FROM documents")
def _e01(spark, sf):
    d = docs(spark, sf)
    parts = [b(d.where(F.col("doc_id") % 4 == i)) for i, b in enumerate((body_a, body_o, body_g, body_generic))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.select("doc_id", F.expr("try_parse_json(body)").alias("_v")).select("doc_id", F.expr(extract.format_sql("_v")).alias("wire_format"))


@query("e02_extract_format_a", f"""
SELECT doc_id, CASE WHEN k = 0 THEN 'system' WHEN (k - 1) % 3 = 0 THEN concat('messages[', {_N1}, '].content')
  ELSE concat('messages[', {_N1}, '].content[0]') END AS path, md5(line) AS md5,
  CASE WHEN k > 0 AND (k - 1) % 3 = 2 THEN concat('src/f', {_N1}, '.key') ELSE '' END AS source_filename
FROM {LINES_SQL} q WHERE line <> ''""")
def _e02(spark, sf):
    return _fields(body_a(docs(spark, sf)))


@query("e03_tool_result_files", f"""
SELECT concat('src/f', {_N1}, '.key') AS source_filename, count(*) AS fields, CAST(sum(length(line)) AS BIGINT) AS chars
FROM {LINES_SQL} q WHERE line <> '' AND k > 0 AND (k - 1) % 3 = 2 GROUP BY 1""")
def _e03(spark, sf):
    f = extract.extract_fields(body_a(docs(spark, sf)).select("doc_id", "body"), formats=("a",))
    return f.where("source_filename <> ''").groupBy("source_filename").agg(F.count("*").alias("fields"), F.sum(F.length("text")).alias("chars"))


@query("e04_extract_format_o", f"""
SELECT doc_id, CASE k % 3 WHEN 0 THEN concat('messages[', {_N}, '].content[0]') WHEN 1 THEN concat('messages[', {_N}, '].content')
  ELSE concat('messages[', {_N}, '].tool_calls[0].function.arguments.q') END AS path, md5(line) AS md5, '' AS source_filename
FROM {LINES_SQL} q WHERE line <> ''""")
def _e04(spark, sf):
    return _fields(body_o(docs(spark, sf)))


@query("e05_extract_format_g", f"""
SELECT doc_id, concat('contents[0].parts[', {_N}, ']', CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '.functionResponse.response.a.b[1]'
  ELSE '.functionCall.args.q' END) AS path, md5(line) AS md5, '' AS source_filename
FROM {LINES_SQL} q WHERE line <> ''""")
def _e05(spark, sf):
    return _fields(body_g(docs(spark, sf)))


@query("e06_nested_walk", f"""
SELECT doc_id, count(*) AS leaves, CAST(sum(length(line)) AS BIGINT) AS chars FROM {LINES_SQL} q WHERE line <> '' AND k % 3 <> 0 GROUP BY doc_id""")
def _e06(spark, sf):
    f = extract.extract_fields(body_g(docs(spark, sf)).select("doc_id", "body"), formats=("g",))
    return f.where(F.col("path").rlike("function")).groupBy("doc_id").agg(F.count("*").alias("leaves"), F.sum(F.length("text")).alias("chars"))


@query("e07_generic_walk", f"SELECT doc_id, concat('rows[', {_N}, '].t') AS path, md5(line) AS md5, '' AS source_filename FROM {LINES_SQL} q WHERE length(line) > 20")
def _e07(spark, sf):
    return _fields(body_generic(docs(spark, sf)))


@query("s01_request_log_scan", f"""
SELECT doc_id, CAST(count(*) FILTER (WHERE line <> '') AS BIGINT) AS fields FROM {LINES_SQL} q WHERE doc_id % 3 = 0 GROUP BY doc_id
HAVING count(*) FILTER (WHERE line <> '') > 0""")
def _s01(spark, sf):
    # Two thirds of the bodies are not JSON objects: a bare array, and broken JSON.
    b = body_a(docs(spark, sf)).withColumn("body", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), "body", F.lit("]"))).when(
        F.col("doc_id") % 3 == 2, F.concat(F.lit("{"), "body")).otherwise(F.col("body")))
    return extract.extract_fields(b.select("doc_id", "body")).groupBy("doc_id").agg(F.count("*").alias("fields"))


# ---- identity --------------------------------------------------------------------------------------
_PATHS = "CASE event_id % 8 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/v1/chat/completions' WHEN 2 THEN '/v1beta/models/x' WHEN 3 THEN '/v1/embeddings' WHEN 4 THEN '/m/generateContent' WHEN 5 THEN '/v1/complete' WHEN 6 THEN '/other' ELSE '/api/completions' END"


def _requests(spark, sf):
    e = table(spark, sf, "events")
    h = ("map_filter(map('x-api-key', if(event_id % 3 = 0, concat('key', user_id), ''), "
         "'authorization', CASE event_id % 5 WHEN 0 THEN concat('Bearer sk-ant-', user_id) WHEN 1 THEN concat('Bearer sk-', user_id) ELSE '' END, "
         "'x-session-id', if(event_id % 7 = 0, concat('sess', user_id), ''), 'x-session-affinity', if(event_id % 7 = 1, concat('aff', user_id), ''), "
         "'x-forwarded-for', if(event_id % 2 = 0, concat(' 10.0.0.', user_id % 250, ' , 8.8.8.8'), ''), "
         "'user-agent', CASE event_id % 6 WHEN 0 THEN concat('aider/0.', user_id, '.1 x') WHEN 1 THEN 'Mozilla/5.0 (X11)' "
         "WHEN 2 THEN concat('ai-sdk/openai/3.', user_id, ' runtime/bun/1.3') WHEN 3 THEN concat('Copilot-CLI/1.', user_id) WHEN 4 THEN concat('mytool/v', user_id) ELSE '' END), "
         "(k, v) -> v <> '')")
    return e.withColumn("path", F.expr(_PATHS)).withColumn("headers", F.expr(h))


@query("e08_provider", f"""
WITH r AS (SELECT event_id, {_PATHS} AS path, event_id % 3 = 0 AS has_key, event_id % 5 AS a FROM events)
SELECT event_id, CASE WHEN path IN ('/v1/messages', '/v1/complete') AND has_key THEN 'anthropic'
  WHEN path IN ('/v1/chat/completions', '/v1/embeddings') THEN 'openai'
  WHEN path IN ('/v1beta/models/x', '/m/generateContent') THEN 'gemini'
  WHEN has_key OR a = 0 THEN 'anthropic' WHEN a = 1 THEN 'openai' ELSE 'anthropic' END AS provider FROM r""")
def _e08(spark, sf):
    return _requests(spark, sf).select("event_id", extract.provider_of("path").alias("provider"))


@query("e09_api_format", f"""
SELECT event_id, CASE WHEN path LIKE '%/messages%' THEN 'anthropic' WHEN path LIKE '%/completions%' THEN 'openai'
  WHEN path LIKE '%/generateContent%' OR path LIKE '%/v1beta/%' THEN 'gemini' ELSE 'openai' END AS api FROM (SELECT event_id, {_PATHS} AS path FROM events) r""")
def _e09(spark, sf):
    return _requests(spark, sf).select("event_id", extract.api_format("path").alias("api"))


@query("e11_client_identity", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'aider' WHEN 2 THEN CASE WHEN event_id % 7 = 1 THEN 'opencode' ELSE concat('ai-sdk/openai/3.', CAST(user_id AS STRING)) END
   WHEN 3 THEN 'copilot' WHEN 4 THEN concat('mytool/v', CAST(user_id AS STRING)) ELSE '' END AS client_id,
 CASE event_id % 6 WHEN 0 THEN concat('0.', CAST(user_id AS STRING), '.1') WHEN 2 THEN CASE WHEN event_id % 7 = 1 THEN '' ELSE concat('openai/3.', CAST(user_id AS STRING)) END
   WHEN 3 THEN concat('1.', CAST(user_id AS STRING)) WHEN 4 THEN concat('v', CAST(user_id AS STRING)) ELSE '' END AS client_version FROM events""")
def _e11(spark, sf):
    c = identity.client_columns(identity.header("user-agent"), F.col("headers"))
    return _requests(spark, sf).select("event_id", c["client_id"].alias("client_id"), c["client_version"].alias("client_version"))


@query("e11_client_registry_join", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'aider' WHEN 3 THEN 'copilot' WHEN 4 THEN 'my_tool' END AS client_id FROM events WHERE event_id % 6 NOT IN (1, 5)""")
def _e11b(spark, sf):
    r = _requests(spark, sf).withColumn("ua_token", identity.client_columns(identity.header("user-agent"), F.col("headers"))["ua_token"])
    reg = identity.registry_frame(spark, [("my_tool", "My Tool", "cli", "multi", ("mytool/",))])
    return identity.client_by_join(r.where("ua_token <> ''").select("event_id", "ua_token"), reg, key=["event_id"])


@query("e13_sdk_metadata", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'aider' WHEN 1 THEN 'Mozilla' WHEN 2 THEN 'ai-sdk/openai' WHEN 3 THEN 'Copilot-CLI' WHEN 4 THEN 'mytool' ELSE '' END AS sdk_name,
 CASE event_id % 6 WHEN 0 THEN concat('0.', CAST(user_id AS STRING), '.1') WHEN 1 THEN '5.0' WHEN 2 THEN concat('3.', CAST(user_id AS STRING))
   WHEN 3 THEN concat('1.', CAST(user_id AS STRING)) WHEN 4 THEN concat('v', CAST(user_id AS STRING)) ELSE '' END AS sdk_version,
 CASE WHEN event_id % 6 = 2 THEN 'bun/1.3' ELSE '' END AS runtime FROM events""")
def _e13(spark, sf):
    c = identity.sdk_columns(identity.header("user-agent"), F.col("headers"))
    return _requests(spark, sf).select("event_id", *[v.alias(k) for k, v in c.items()])


@query("e14_client_type", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cli' WHEN 2 THEN CASE WHEN event_id % 7 = 1 THEN 'cli' ELSE '' END WHEN 3 THEN 'ide' ELSE '' END AS client_type FROM events""")
def _e14(spark, sf):
    c = identity.client_columns(identity.header("user-agent"), F.col("headers"))
    return _requests(spark, sf).select("event_id", identity.client_type(c["client_id"], F.col("headers")).alias("client_type"))


@query("e15_system_text", f"SELECT doc_id, md5(line) AS md5 FROM {LINES_SQL} q WHERE k = 0")
def _e15(spark, sf):
    b = body_a(docs(spark, sf)).select("doc_id", F.lit("anthropic").alias("provider"), F.expr("try_parse_json(body)").alias("_v"))
    return b.select("doc_id", F.md5(identity.system_text("_v", "provider")).alias("md5"))


@query("e16_prompt_fields", """
SELECT doc_id, concat('/srv/', source, '/', CAST(doc_id AS STRING)) AS working_directory, concat('feature/', lang) AS git_branch, 'linux ' || CAST(doc_id % 5 AS STRING) AS os_platform FROM documents""")
def _e16(spark, sf):
    d = docs(spark, sf).select("doc_id", F.lit("openai").alias("provider"), F.lit("1.1.1.1").alias("source_ip"), F.expr("map('x', 'y')").alias("headers"), F.expr(
        "to_json(named_struct('messages', array(named_struct('role', 'system', 'content', concat('cwd: \\'/srv/', source, '/', doc_id, '\\'\\nGit branch:  feature/', lang, ' \\nPlatform: linux ', doc_id % 5, '\\n', text)))))"
    ).alias("body"))
    return identity.identify(d).select("doc_id", "working_directory", "git_branch", "os_platform")


@query("e17_session_identity", f"""
WITH l AS (SELECT doc_id, max(CASE WHEN k = 0 THEN line END) AS l0, max(CASE WHEN k = 1 THEN line END) AS l1,
   max(CASE WHEN k = 2 THEN line END) AS l2 FROM {LINES_SQL} q GROUP BY doc_id),
p AS (SELECT doc_id, concat('anthropic', chr(10), l0, CASE WHEN l1 IS NOT NULL THEN concat(chr(10), l1) ELSE '' END,
   CASE WHEN l2 IS NOT NULL THEN concat(chr(10), l2) ELSE '' END) AS s FROM l)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('hdr', CAST(doc_id AS STRING)) WHEN 1 THEN concat('meta', CAST(doc_id AS STRING))
   ELSE concat('fp:', sha256(s)) END AS session_id,
 CASE doc_id % 4 WHEN 1 THEN concat('acct', CAST(doc_id AS STRING)) WHEN 2 THEN 'plain' ELSE '' END AS account_id,
 CASE WHEN doc_id % 2 = 0 THEN '1.2.3.4' ELSE '9.9.9.9' END AS source_ip_resolved FROM p""")
def _e17(spark, sf):
    meta = (
        "CASE doc_id % 4 WHEN 1 THEN concat(',\"metadata\":{\"user_id\":\"{\\\\\"account_uuid\\\\\":\\\\\"acct', doc_id, '\\\\\",\\\\\"session_id\\\\\":\\\\\"meta', doc_id, '\\\\\"}\"}}') "
        "WHEN 2 THEN ',\"metadata\":{\"user_id\":\"plain\"}}' ELSE '}' END"
    )
    d = body_a(docs(spark, sf)).withColumn("body", F.expr(f"concat(substr(body, 1, length(body) - 1), {meta})"))
    h = F.expr("map_filter(map('x-session-id', if(doc_id % 4 = 0, concat('hdr', doc_id), ''), 'x-forwarded-for', if(doc_id % 2 = 0, '1.2.3.4, 5.6.7.8', '')), (k, v) -> v <> '')")
    d = d.select("doc_id", "body", h.alias("headers"), F.lit("anthropic").alias("provider"), F.lit("9.9.9.9").alias("source_ip"))
    return identity.identify(d).select("doc_id", "session_id", "account_id", "source_ip_resolved")


@query("e18_session_fingerprint", f"""
WITH l AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS s FROM {LINES_SQL} q WHERE k < 3 GROUP BY doc_id)
SELECT doc_id, concat('fp:', sha256(concat('anthropic', chr(10), s))) AS fp FROM l""")
def _e18(spark, sf):
    d = body_a(docs(spark, sf)).select("doc_id", F.lit("anthropic").alias("provider"), F.expr("try_parse_json(body)").alias("_v"))
    # Third message of body_a holds a tool result, so only plain and text blocks enter the fingerprint.
    return d.select("doc_id", identity.session_fingerprint("_v", "provider").alias("fp"))


def _hmac_sql(key: bytes, expr: str) -> str:
    k = key.ljust(64, b"\0")
    ip, op = "".join(f"\\x{b ^ 0x36:02X}" for b in k), "".join(f"\\x{b ^ 0x5C:02X}" for b in k)
    return f"sha256('{op}'::BLOB || unhex(sha256('{ip}'::BLOB || encode({expr}))))"


@query("e20_api_key_hash", f"SELECT c_custkey, substr({_hmac_sql(b'pepper', 'c_name')}, 1, 16) AS api_key_hash FROM customer")
def _e20(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.substring(tx.hmac_sha256(b"pepper", "c_name"), 1, 16).alias("api_key_hash"))


@query("e24_project_name", """
SELECT page_id, list_extract(string_split(url, '/'), -1) AS project, list_extract(string_split(replace(url, '/', chr(92)), chr(92)), -1) AS project_backslash FROM pages""")
def _e24(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.project_name("url").alias("project"), tx.project_name(F.replace("url", F.lit("/"), F.lit("\\"))).alias("project_backslash"))


# ---- diffs --------------------------------------------------------------------------------------------
_DIFF = (
    "concat('diff --git a/x b/x\\n--- a/x\\n+++ b/src/first.py\\n', array_join(transform(split(text, '\\n'), (l, i) -> concat(if(i % 3 = 2, '-', '+'), l)), '\\n'), "
    "'\\nBinary files a/i.png and b/i.png differ\\n+++ b/src/', lang, '.py\\n', array_join(transform(split(text, '\\n'), l -> concat('+', l)), '\\n'), '\\n context')"
)


def diffs(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("diff_id"), F.expr(_DIFF).alias("diff"))


@query("s04_unified_diff", f"""
SELECT doc_id AS diff_id, 'src/first.py' AS file, md5(string_agg(line, chr(10) ORDER BY k)) AS md5 FROM {LINES_SQL} q
WHERE k % 3 <> 2 AND NOT starts_with(line, '++') GROUP BY doc_id
UNION ALL SELECT q.doc_id, concat('src/', d.lang, '.py'), md5(string_agg(line, chr(10) ORDER BY k)) FROM {LINES_SQL} q JOIN documents d USING (doc_id)
WHERE NOT starts_with(line, '++') GROUP BY q.doc_id, d.lang""")
def _s04(spark, sf):
    return files.diff_files(diffs(spark, sf)).select("diff_id", "file", md5())


@query("w04_header_carry", f"""
SELECT CASE WHEN s = 0 THEN 'src/first.py' ELSE concat('src/', lang, '.py') END AS file, count(*) AS added, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
 SELECT 0 AS s, lang, line FROM {LINES_SQL} q JOIN documents d USING (doc_id) WHERE k % 3 <> 2
 UNION ALL SELECT 1, lang, line FROM {LINES_SQL} q JOIN documents d USING (doc_id)) x WHERE NOT starts_with(line, '++') GROUP BY 1""")
def _w04(spark, sf):
    return files.diff_lines(diffs(spark, sf)).groupBy("file").agg(F.count("*").alias("added"), F.sum(F.length("added")).alias("chars"))
