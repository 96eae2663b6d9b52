"""Who sent a request: client, SDK, session, account, environment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.functions import text as tx
from dredgeline.functions.clients import CLIENTS
from dredgeline.operators.extract import _get, _is_str, _list, _str

Client = tuple[str, str, str, str, tuple[str, ...]]

# --- fixed values: system-prompt patterns, tried in order --------------------------------
WORKDIR = (r"(?:Primary )?[Ww]orking directory:\s*(.+?)(?:\n|$)", r"You are working in:\s*(.+?)(?:\n|$)",
           r"(?i)(?:cwd|working_directory):\s*(.+?)(?:\n|$)")
BRANCH = (r"Current branch:\s*(.+?)(?:\n|$)", r"(?i)(?:git branch|branch):\s*(.+?)(?:\n|$)")
PLATFORM = (r"Platform:\s*(.+?)(?:\n|$)", r"(?i)(?:os|operating system):\s*(.+?)(?:\n|$)")
CLIENT_TYPES = ("cli", "ide", "app", "web", "browser_extension")
SESSION_HEADERS = ("x-session-id", "x-opencode-session", "x-session-affinity")

_WS = r"[ \t\r\n\f\x0B]+"


def header(name: str, headers: str | Column = "headers") -> Column:
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.coalesce(F.try_element_at(h, F.lit(name)), F.lit(""))


def _first_token(ua: Column) -> Column:
    return F.regexp_extract(ua, r"\A\s*(\S*)", 1)


def client_columns(ua: Column, headers: Column, clients: Sequence[Client] = CLIENTS) -> dict[str, Column]:
    """client_id, client_display, client_version, ua_token.

    The registry is a short ordered list, so it is unrolled into the expression: first
    matching prefix wins, then the header fallback, then the raw token.
    """
    browser = (ua == "") | ua.startswith("Mozilla/")
    token = _first_token(ua)
    low = F.lower(token)
    fallback = F.map_contains_key(headers, "x-opencode-session") | (
        low.startswith("ai-sdk/") & F.map_contains_key(headers, "x-session-affinity")
    )
    version = tx._c(F.when(F.contains(token, F.lit("/")), F.regexp_replace(token, r"\A[^/]*/", "")).otherwise(""))
    parsed = F.regexp_extract(version, r"\A\d+\.\d+(?:\.\d+)?(?:[.-]\w+)?", 0)
    version = F.when(parsed != "", parsed).otherwise(version)
    cid = disp = F.when(fallback, None).otherwise(token)
    names = {c[0]: c[1] for c in clients}
    cid = F.when(fallback, F.lit("opencode")).otherwise(token)
    disp = F.when(fallback, F.lit(names.get("opencode", "opencode"))).otherwise(token)
    known = F.lit(False)
    for c, d, _cat, _prov, prefixes in reversed([x for x in clients]):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | low.startswith(p)
        cid, disp, known = F.when(hit, c).otherwise(cid), F.when(hit, d).otherwise(disp), known | hit
    blank = lambda c: F.when(browser, "").otherwise(c)
    return {
        "client_id": blank(cid),
        "client_display": blank(disp),
        "client_version": blank(F.when(~known & fallback, "").otherwise(version)),
        "ua_token": blank(token),
    }


def client_by_join(df: DataFrame, registry: DataFrame, token: str = "ua_token", key: Sequence[str] = ("req_id",),
                   max_rows: int = 10_000) -> DataFrame:
    """Registry as a table (extra clients included): prefix join against a side of checked size."""
    n = registry.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"client registry holds more than {max_rows} rows")
    hit = df.join(F.broadcast(registry), F.lower(token).startswith(registry["prefix"]), "left")
    return hit.groupBy(*key).agg(F.min_by("client_id", "order_no").alias("client_id"))


def registry_frame(spark, extra: Sequence[Client] = ()) -> DataFrame:
    rows, n = [], 0
    for cid, disp, cat, prov, prefixes in [*CLIENTS, *extra]:
        for p in prefixes:
            rows.append((n, p, cid, disp, cat, prov))
            n += 1
    return spark.createDataFrame(rows, "order_no int, prefix string, client_id string, display_name string, category string, provider string")


def sdk_columns(ua: Column, headers: Column) -> dict[str, Column]:
    first = _first_token(ua)
    parts = F.split(first, "/")
    ai = first.startswith("ai-sdk/")
    cut = F.length(first) - F.locate("/", F.reverse(first)) + 1  # position of the last slash
    slash = F.contains(first, F.lit("/")) & (cut > 1)
    name = F.when(ai & (F.size(parts) >= 3), F.concat_ws("/", parts[0], parts[1])).when(ai, first).when(
        slash, F.substr(first, F.lit(1), cut - 1)).otherwise(first)
    ver = F.when(ai & (F.size(parts) >= 3), parts[2]).when(ai, "").when(slash, F.substr(first, cut + 1)).otherwise("")
    lang, pkg = header("x-stainless-lang", headers), header("x-stainless-package-version", headers)
    rt, rtv = header("x-stainless-runtime", headers), header("x-stainless-runtime-version", headers)
    over = (lang != "") & (pkg != "")
    run = F.regexp_extract(ua, r"(?:\A|\s)runtime/(\S*)", 1)
    run = F.when((run == "") & (rt != "") & (rtv != ""), F.concat_ws("/", rt, rtv)).otherwise(run)
    blank = lambda c: F.when(F.trim(ua) == "", "").otherwise(c)
    return {
        "sdk_name": blank(F.when(over, F.concat(F.lit("openai-"), lang)).otherwise(name)),
        "sdk_version": blank(F.when(over, pkg).otherwise(ver)),
        "runtime": blank(run),
    }


def client_type(client_id: Column, headers: Column, clients: Sequence[Client] = CLIENTS) -> Column:
    explicit = header("x-opencode-client", headers)
    out = F.lit("")
    for kind in CLIENT_TYPES:
        ids = [c[0] for c in clients if c[2] == kind]
        if ids:
            out = F.when(client_id.isin(*ids), kind).otherwise(out)
    return F.when(explicit != "", explicit).otherwise(out)


def system_text(v: str = "_v", provider: str = "provider") -> Column:
    """System prompt of a parsed body, by wire format."""
    block = (
        f"CASE WHEN {_is_str('b')} THEN cast(b as string) "
        f"WHEN try_variant_get(b, '$', 'map<string,variant>') IS NOT NULL THEN coalesce({_str('b', '$.text')}, '') END"
    )
    a = f"coalesce({_str(v, '$.system')}, array_join(transform({_list(v, '$.system')}, b -> {block}), '\\n'))"
    o_msgs = f"filter(transform(filter({_list(v, '$.messages')}, m -> {_str('m', '$.role')} = 'system'), m -> " \
             f"CASE WHEN {_get('m', '$.content')} IS NULL THEN '' ELSE {_str('m', '$.content')} END), t -> t IS NOT NULL)"
    o = f"coalesce(try_element_at({o_msgs}, 1), {_str(v, '$.instructions')}, '')"
    g = f"coalesce({_str(v, '$.systemInstruction.parts[0].text')}, '')"
    return F.expr(f"coalesce(CASE {provider} WHEN 'anthropic' THEN {a} WHEN 'openai' THEN {o} WHEN 'gemini' THEN {g} END, '')")


def prompt_field(system: Column, patterns: Sequence[str], path: bool = False) -> Column:
    """First pattern that matches gives the value, even if it is blank after trimming."""
    raw = F.lit("")
    for p in reversed(patterns):
        whole = F.regexp_extract(system, "(?dU)" + p, 0)
        raw = F.when(whole != "", F.regexp_extract(system, "(?dU)" + p, 1)).otherwise(raw)
    val = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    if path:
        val = F.regexp_replace(val, r"""\A['"]+|['"]+\z""", "")
    return val


def session_fingerprint(v: str = "_v", provider: str = "provider", chars: int | None = None, digits: int = 64) -> Column:
    """``fp:`` and a hash over provider, system prompt and first messages; '' if bare.

    Whole texts and the whole SHA-256 by default; ``chars`` and ``digits`` shorten both.
    """
    part = lambda e: f"substr({e}, 1, {chars})" if chars else e

    def content(m: str) -> str:
        first = f"try_variant_get({m}, '$.content[0]', 'variant')"
        return (
            f"CASE WHEN try_variant_get({m}, '$', 'map<string,variant>') IS NULL THEN NULL "
            f"WHEN {_get(m, '$.content')} IS NULL THEN '' "
            f"WHEN {_str(m, '$.content')} IS NOT NULL THEN {part(_str(m, '$.content'))} "
            f"WHEN try_variant_get({first}, '$', 'map<string,variant>') IS NOT NULL THEN {part('coalesce(' + _str(m, '$.content[0].text') + ', ' + chr(39) * 2 + ')')} END"
        )

    def messages(key: str, n: int) -> str:
        return f"transform(slice({_list(v, '$.' + key)}, 1, {n}), m -> {content('m')})"

    sys_a = (
        f"CASE WHEN {_get(v, '$.system')} IS NULL THEN '' WHEN {_str(v, '$.system')} IS NOT NULL THEN {part(_str(v, '$.system'))} "
        f"WHEN try_variant_get({v}, '$.system[0]', 'map<string,variant>') IS NOT NULL THEN {part('coalesce(' + _str(v, '$.system[0].text') + ', ' + chr(39) * 2 + ')')} END"
    )
    a = f"concat(array({sys_a}), {messages('messages', 2)})"
    item = "coalesce(" + ", ".join([
        f"CASE WHEN {_str(v, '$.input')} IS NOT NULL THEN {part(_str(v, '$.input'))} END",
        f"CASE WHEN {_str(v, '$.input[0]')} IS NOT NULL THEN {part(_str(v, '$.input[0]'))} END",
        content(f"variant_get({v}, '$.input[0]', 'variant')"),
    ]) + ")"
    instr = f"CASE WHEN coalesce({_str(v, '$.instructions')}, '') <> '' THEN {part(_str(v, '$.instructions'))} END"
    o = f"CASE WHEN size({_list(v, '$.messages')}) > 0 THEN {messages('messages', 3)} ELSE array({instr}, {item}) END"
    g_first = lambda m: (f"CASE WHEN try_variant_get({m}, '$.parts[0]', 'map<string,variant>') IS NOT NULL "  # noqa: E731
                         f"THEN {part('coalesce(' + _str(m, '$.parts[0].text') + ', ' + chr(39) * 2 + ')')} END")
    g = f"concat(array({g_first(f'variant_get({v}, ' + chr(39) + '$.systemInstruction' + chr(39) + ', ' + chr(39) + 'variant' + chr(39) + ')')}), transform(slice({_list(v, '$.contents')}, 1, 2), m -> {g_first('m')}))"
    parts = f"array_compact(CASE {provider} WHEN 'anthropic' THEN {a} WHEN 'openai' THEN {o} WHEN 'gemini' THEN {g} END)"
    return F.expr(
        f"CASE WHEN size({parts}) >= 1 THEN concat('fp:', substr(sha2(array_join(concat(array({provider}), {parts}), '\\n'), 256), 1, {digits})) ELSE '' END"
    )


def identify(
    df: DataFrame,
    body: str = "body",
    headers: str = "headers",
    provider: str = "provider",
    source_ip: str = "source_ip",
    trusted: str | None = None,
    relay_prefix: str = "x-relay-",
    hmac_key: bytes = b"",
    clients: Sequence[Client] = CLIENTS,
) -> DataFrame:
    """Add the identity columns of a request row; missing values are '' throughout.

    ``trusted`` names a boolean column: only trusted rows may set identity through relay
    headers. Session id order: explicit headers, body metadata, derived fingerprint. Values are whole:
    they are matched and keyed as they came; :func:`shorten` cuts them for a store that needs it.
    """
    h = F.col(headers)
    hd = lambda k: header(k, h)
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    ok = F.col(trusted) if trusted else F.lit(False)
    relay = lambda k: F.when(ok, hd(relay_prefix + k)).otherwise("")

    out = df.withColumn("_v", F.expr(f"CASE WHEN {body} rlike '\\\\A[ \\\\t\\\\r\\\\n]*\\\\{{' THEN try_parse_json({body}) END"))
    meta = _get("_v", "$.metadata.user_id")
    uid = f"CASE WHEN {_str('_v', '$.metadata.user_id')} LIKE '{{%' THEN coalesce(try_parse_json({_str('_v', '$.metadata.user_id')}), {meta}) ELSE {meta} END"
    out = out.withColumn("_uid", F.expr(f"CASE WHEN {provider} = 'anthropic' THEN {uid} END"))
    out = out.withColumn("_sys", system_text("_v", provider))
    is_obj = F.expr("try_variant_get(_uid, '$', 'map<string,variant>') IS NOT NULL")
    member = lambda k: F.coalesce(F.when(is_obj, F.expr(f"try_variant_get(_uid, '$.{k}', 'string')")), F.lit(""))
    scalar = F.coalesce(F.when(~is_obj, F.expr("try_variant_get(_uid, '$', 'string')")), F.lit(""))
    user = F.coalesce(F.when(F.col(provider) == "openai", F.expr("try_variant_get(_v, '$.user', 'string')")), F.lit(""))

    ua = hd("user-agent")
    key = first(hd("x-api-key"), hd("authorization"))
    bare = F.when(F.lower(key).startswith("bearer "), F.substr(key, F.lit(8))).otherwise(key)
    client = client_columns(ua, h, clients)
    cols = {
        "account_id": first(relay("account-id"), member("account_uuid"), scalar, user),
        "session_id": first(*[hd(k) for k in SESSION_HEADERS], member("session_id"),
                            F.when(F.col("_v").isNotNull(), session_fingerprint("_v", provider)).otherwise("")),
        "device_id": first(relay("device-id"), member("device_id")),
        "source_ip_resolved": first(F.trim(F.split(hd("x-forwarded-for"), ",")[0]), F.coalesce(F.col(source_ip), F.lit(""))),
        "working_directory": first(relay("working-dir"), prompt_field(F.col("_sys"), WORKDIR, path=True)),
        "git_branch": first(relay("git-branch"), prompt_field(F.col("_sys"), BRANCH)),
        "os_platform": first(relay("os-platform"), prompt_field(F.col("_sys"), PLATFORM)),
        "hostname": relay("hostname"),
        "username": relay("username"),
        "client_name": client["client_id"],
        "client_version": client["client_version"],
        "client_type": client_type(client["client_id"], h, clients),
        "raw_user_agent": ua,
        **sdk_columns(ua, h),
        "api_key_hash": F.when(key != "", F.substring(tx.hmac_sha256(hmac_key, bare), 1, 16)).otherwise(""),
    }
    return out.select(*df.columns, *[c.alias(k) for k, c in cols.items()])


#: Characters that a record of the usual width keeps of each column.
WIDTHS = {
    "account_id": 256, "session_id": 256, "device_id": 256, "working_directory": 512, "git_branch": 256, "os_platform": 64, "hostname": 256, "username": 256,
    "client_name": 128, "client_type": 64, "raw_user_agent": 512, "sdk_name": 128, "sdk_version": 128, "runtime": 128,
}


def shorten(df: DataFrame, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """An output step only: identity columns cut to ``widths``. Different long values may become equal, so join and group before it."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items() if c in df.columns})
