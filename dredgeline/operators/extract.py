"""Text fields out of JSON request bodies.

A body is parsed once to VARIANT; fields are an array inside the row until the caller
explodes them, so extraction never shuffles and never re-reads the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<path: string, v: variant, source_filename: string>"
_NONE = f"cast(array() as array<{FIELD}>)"


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def _list(v: str, path: str = "$") -> str:
    """The list at a path; empty when it is missing or something else."""
    return f"coalesce(try_variant_get({v}, '{path}', 'array<variant>'), cast(array() as array<variant>))"


def _is_str(v: str) -> str:
    return f"schema_of_variant({v}) = 'STRING'"


def _str(v: str, path: str) -> str:
    """The string at a path; NULL when missing or of another type."""
    x = _get(v, path)
    return f"CASE WHEN {_is_str(x)} THEN try_variant_get({v}, '{path}', 'string') END"


def _one(cond: str, path: str, v: str, source: str = "''") -> str:
    return f"CASE WHEN {cond} THEN array(struct({path} as path, {v} as v, {source} as source_filename)) ELSE {_NONE} END"


def _text_leaf(v: str, at: str, path: str, source: str = "''") -> str:
    """A field for a non-empty string at ``at``, else nothing."""
    return _one(f"coalesce({_str(v, at)}, '') <> ''", path, _get(v, at), source)


def _each(lst: str, body: str, x: str, i: str) -> str:
    return f"flatten(transform({lst}, ({x}, {i}) -> {body}))"


def _nested(v: str, at: str, path: str) -> str:
    """An object to be walked later (only objects count)."""
    return _one(f"try_variant_get({v}, '{at}', 'map<string,variant>') IS NOT NULL", path, _get(v, at))


def format_sql(v: str = "_v") -> str:
    """Wire format by the keys present: ``system`` -> a, Gemini keys -> g, ``messages`` -> o."""
    has = lambda k: f"variant_get({v}, '$.{k}', 'variant') IS NOT NULL"  # noqa: E731  JSON null counts as present
    return f"CASE WHEN {has('system')} THEN 'a' WHEN {has('systemInstruction')} OR {has('contents')} THEN 'g' WHEN {has('messages')} THEN 'o' ELSE 'generic' END"


#: Provider name -> wire format; any other provider is detected from the body.
PROVIDER_FORMAT = {"anthropic": "a", "openai": "o", "gemini": "g"}


def _format_a(v: str) -> str:
    system = (
        f"concat({_text_leaf(v, '$.system', chr(39) + 'system' + chr(39))}, "
        + _each(_list(v, "$.system"), _text_leaf("b", "$.text", "concat('system[', i, ']')"), "b", "i")
        + ")"
    )
    base = "concat('messages[', i, '].content[', j, ']')"
    name = " , ".join(f"nullif({_str('b', f'$.input.{k}')}, '')" for k in ("file_path", "path", "filename"))
    source = f"coalesce({name}, '')"
    tool = (
        f"concat({_text_leaf('b', '$.content', base, source)}, "
        + _each(
            _list("b", "$.content"),
            f"CASE WHEN {_str('s', '$.type')} = 'text' THEN "
            + _text_leaf("s", "$.text", f"concat({base}, '.content[', k, ']')", source)
            + f" ELSE {_NONE} END",
            "s", "k",
        )
        + ")"
    )
    block = (
        f"CASE WHEN {_str('b', '$.type')} = 'text' THEN {_text_leaf('b', '$.text', base)} "
        f"WHEN {_str('b', '$.type')} = 'tool_result' THEN {tool} ELSE {_NONE} END"
    )
    msg = (
        f"concat({_text_leaf('m', '$.content', 'concat(' + chr(39) + 'messages[' + chr(39) + ', i, ' + chr(39) + '].content' + chr(39) + ')')}, "
        + _each(_list("m", "$.content"), block, "b", "j") + ")"
    )
    return f"concat({system}, {_each(_list(v, '$.messages'), msg, 'm', 'i')})"


def _format_o(v: str) -> str:
    at = "concat('messages[', i, '].content')"
    part = (
        f"CASE WHEN {_str('b', '$.type')} = 'text' THEN "
        + _text_leaf("b", "$.text", "concat('messages[', i, '].content[', j, ']')") + f" ELSE {_NONE} END"
    )
    parts = _each(_list("m", "$.content"), part, "b", "j")
    role = f"coalesce({_str('m', '$.role')}, '')"
    args = _str("t", "$.function.arguments")
    parsed = f"try_parse_json({args})"
    arg_path = "concat('messages[', i, '].tool_calls[', k, '].function.arguments')"
    arg_fields = (
        f"flatten(transform(map_entries(coalesce(try_variant_get({parsed}, '$', 'map<string,variant>'), cast(map() as map<string,variant>))), "
        f"e -> CASE WHEN {_is_str('e.value')} AND try_variant_get(e.value, '$', 'string') <> '' "
        f"THEN array(struct(concat({arg_path}, '.', e.key) as path, e.value as v, '' as source_filename)) ELSE {_NONE} END))"
    )
    call = (
        f"CASE WHEN coalesce({args}, '') = '' THEN {_NONE} "
        f"WHEN {parsed} IS NOT NULL THEN {arg_fields} "
        f"WHEN length({args}) > 20 THEN array(struct({arg_path} as path, {_get('t', '$.function.arguments')} as v, '' as source_filename)) "
        f"ELSE {_NONE} END"
    )
    calls = _each(_list("m", "$.tool_calls"), call, "t", "k")
    msg = (
        f"concat({_text_leaf('m', '$.content', at)}, CASE WHEN {role} <> 'tool' THEN {parts} ELSE {_NONE} END, "
        f"CASE WHEN {role} = 'assistant' THEN {calls} ELSE {_NONE} END)"
    )
    return _each(_list(v, "$.messages"), msg, "m", "i")


def _format_g(v: str) -> str:
    system = _each(
        _list(v, "$.systemInstruction.parts"), _text_leaf("p", "$.text", "concat('systemInstruction.parts[', i, ']')"), "p", "i"
    )
    base = "concat('contents[', i, '].parts[', j, ']')"
    part = (
        f"concat({_text_leaf('p', '$.text', base)}, "
        + _nested("p", "$.functionResponse.response", f"concat({base}, '.functionResponse.response')") + ", "
        + _nested("p", "$.functionCall.args", f"concat({base}, '.functionCall.args')") + ")"
    )
    content = _each(_list("c", "$.parts"), part, "p", "j")
    return f"concat({system}, {_each(_list(v, '$.contents'), content, 'c', 'i')})"


def _walk_step(arr: str) -> str:
    """Replace every container by its children, keeping order; leaves stay."""
    members = (
        "transform(map_entries(try_variant_get(x.v, '$', 'map<string,variant>')), e -> "
        "struct(if(x.path = '', e.key, concat(x.path, '.', e.key)) as path, e.value as v, x.source_filename as source_filename))"
    )
    items = (
        "transform(try_variant_get(x.v, '$', 'array<variant>'), (e, i) -> "
        "struct(concat(x.path, '[', i, ']') as path, e as v, x.source_filename as source_filename))"
    )
    return f"flatten(transform({arr}, x -> coalesce({members}, {items}, array(x))))"


_OPEN = (
    "exists({arr}, x -> try_variant_get(x.v, '$', 'map<string,variant>') IS NOT NULL "
    "OR try_variant_get(x.v, '$', 'array<variant>') IS NOT NULL)"
)


def extract_fields(
    df: DataFrame,
    body: str = "body",
    provider: str | None = None,
    max_depth: int = 64,
    as_array: bool = False,
    formats: tuple[str, ...] = ("a", "o", "g", "generic"),
) -> DataFrame:
    """Adds the text fields of each body: field_no, path, text, source_filename.

    ``provider`` names a column whose known values fix the format. Bodies that are not JSON
    objects have no fields. Nesting below ``max_depth`` is not lost: the remaining container
    becomes one field holding its JSON text. With ``as_array`` the row keeps one ``fields``
    array instead of being exploded.
    """
    keep = [c for c in df.columns if c != body]
    # Not as a filter, which would move below the column and build a computed body once more.
    opens = F.startswith(F.ltrim(F.col(body), F.lit(" \t\r\n")), F.lit("{"))
    out = df.withColumn("_v", F.when(opens, F.try_parse_json(F.col(body))))
    fmt = format_sql("_v")
    if provider:
        known = " ".join(f"WHEN '{p}' THEN '{f}'" for p, f in PROVIDER_FORMAT.items())
        fmt = f"CASE {provider} {known} ELSE {fmt} END"
    out = out.withColumn("_fmt", F.expr(fmt))
    arms = {"a": _format_a("_v"), "o": _format_o("_v"), "g": _format_g("_v"),
            "generic": "array(struct('' as path, _v as v, '' as source_filename))"}
    out = out.withColumn("_w", F.expr("CASE _fmt " + " ".join(f"WHEN '{f}' THEN {arms[f]}" for f in formats) + " END"))
    if "g" in formats or "generic" in formats:
        # A fold over a short sequence, one level per step: the plan stays small at any depth.
        walked = (
            f"aggregate(sequence(1, {max_depth}), cast(_w as array<{FIELD}>), "
            f"(a, n) -> cast(CASE WHEN {_OPEN.format(arr='a')} THEN {_walk_step('a')} ELSE a END as array<{FIELD}>))"
        )
        out = out.withColumn("_w", F.expr(f"CASE WHEN _fmt IN ('g', 'generic') THEN {walked} ELSE _w END"))
    leaf = (
        "filter(transform(filter(_w, x -> schema_of_variant(x.v) = 'STRING' OR " + _OPEN.format(arr="array(x)") + "), "
        "x -> struct(x.path as path, cast(x.v as string) as text, x.source_filename as source_filename)), "
        "f -> f.text <> '' AND (_fmt <> 'generic' OR length(f.text) > 20))"
    )
    out = out.select(*keep, F.col("_fmt").alias("wire_format"), F.expr(leaf).alias("fields"))
    return out if as_array else explode_fields(out)


def explode_fields(df: DataFrame) -> DataFrame:
    """One row per field. The outer form plus a filter keeps the optimizer from adding a
    ``size(fields) > 0`` filter below, which would evaluate the whole extraction twice."""
    rest = [c for c in df.columns if c != "fields"]
    return df.select(*rest, F.posexplode_outer("fields").alias("field_no", "_f")).where("_f IS NOT NULL").select(
        *rest, "field_no", F.col("_f.path").alias("path"), F.col("_f.text").alias("text"),
        F.col("_f.source_filename").alias("source_filename"),
    )


# ---- classification of the log line ------------------------------------------------------
def api_format(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    has = lambda s: F.contains(p, F.lit(s))
    return (
        F.when(has("/messages"), "anthropic")
        .when(has("/completions"), "openai")
        .when(has("/generateContent") | has("/v1beta/"), "gemini")
        .otherwise("openai")
    )


def provider_of(path: str | Column, headers: str | Column = "headers") -> Column:
    """Ordered path rules, then header rules; the default is the first format's provider."""
    p = F.col(path) if isinstance(path, str) else path
    h = F.col(headers) if isinstance(headers, str) else headers
    get = lambda k: F.coalesce(F.try_element_at(h, F.lit(k)), F.lit(""))
    starts = lambda *ps: F.greatest(*[p.startswith(x) for x in ps], F.lit(False))
    auth = get("authorization")
    return (
        F.when(starts("/v1/messages", "/v1/complete") & ((get("x-api-key") != "") | (get("anthropic-version") != "")), "anthropic")
        .when(starts("/v1/chat/completions", "/v1/completions", "/v1/embeddings"), "openai")
        .when(F.contains(p, F.lit("/generateContent")) | p.startswith("/v1beta/"), "gemini")
        .when(F.map_contains_key(h, "x-api-key") | auth.startswith("Bearer sk-ant-"), "anthropic")
        .when(auth.startswith("Bearer sk-"), "openai")
        .otherwise("anthropic")
    )
