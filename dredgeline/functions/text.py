"""String, hash and codec expressions. Everything is a Column unless it says otherwise."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udf

_WHOLE = T.StructType([T.StructField("url", T.StringType()), T.StructField("esc", T.StringType())])

# --- fixed values: invisible characters removed before matching ---------------------
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}\x{feff}]"
# --- fixed values: encoded-run shapes -------------------------------------------------
BASE64_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,3}(?![A-Za-z0-9+/=])"
HEX_RUN = r"(?U)\b[0-9a-fA-F]{16,}\b"
UNICODE_RUN = r"(?:\\u[0-9a-fA-F]{4}){2,}"


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- masking -------------------------------------------------------------------------
def mask_short(c) -> Column:
    """First four characters and ``****``; nothing of values up to four characters."""
    c = _c(c)
    return F.when(F.length(c) <= 4, F.lit("****")).otherwise(F.concat(F.substring(c, 1, 4), F.lit("****")))


def mask_ends(c) -> Column:
    """First four and last two characters around ``****``; first two of short values."""
    c = _c(c)
    return F.when(F.length(c) <= 8, F.concat(F.substring(c, 1, 2), F.lit("****"))).otherwise(
        F.concat(F.substring(c, 1, 4), F.lit("****"), F.substring(c, -2, 2))
    )


# ---- sanitising ------------------------------------------------------------------------
_INVISIBLE = "".join(map(chr, (*range(0x200B, 0x2010), *range(0x2028, 0x202F), 0x2060, 0xFEFF)))


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def strip_zero_width(c) -> Column:
    """Without the characters of ``ZERO_WIDTH``; a look-up per character, far cheaper than a pattern of several ranges."""
    c = _c(c)
    return F.when(_beyond_ascii(c), F.translate(c, _INVISIBLE, "")).otherwise(c)


# Plain functions, not Arrow ones: Spark sends them a hundred texts at a time, so that what a worker holds does
# not follow the size of an Arrow batch of whole texts.
@udf(T.StringType(), useArrow=False)
def _nfkc(t: str | None) -> str | None:
    return t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)


def sanitize(c) -> Column:
    """Zero-width strip, then NFKC. Texts of Western letters never leave the JVM (they travel as NULL).

    ASCII and U+00C0 to U+0131 are neither invisible nor changed by NFKC, whichever of them stand together.
    Two searches for one range each: a class of several ranges takes ten times as long.
    """
    c = _c(c)
    odd = _beyond_ascii(c) & (c.rlike(r"[^\x{0}-\x{131}]") | c.rlike(r"[\x{a0}-\x{bf}]"))
    return F.coalesce(_nfkc(F.when(odd, strip_zero_width(c))), c)


# ---- decoding --------------------------------------------------------------------------
def meaningful(c, min_length: int = 8, ratio: float = 0.7) -> Column:
    """Long enough and mostly printable ASCII."""
    c = _c(c)
    return (F.length(c) >= min_length) & (F.length(F.regexp_replace(c, "[^ -~]", "")) / F.length(c) >= ratio)


def cut_sql(text: str, max_len: int | None) -> str:
    return text if max_len is None else f"substr({text}, 1, {max_len})"


def _decoded_array(runs_sql: str, to_binary: str, keep: str, min_len: int, max_len: int | None) -> str:
    """SQL: matched runs -> decoded, meaningful, capped strings (with the run itself)."""
    text = f"translate(make_valid_utf8(cast({to_binary} as string)), '\\uFFFD', '')"
    return (
        f"transform(filter(transform(filter({runs_sql}, s -> {keep}), s -> {text}), "
        f"d -> length(d) >= {min_len} AND length(regexp_replace(d, '[^ -~]', '')) / length(d) >= 0.7), "
        f"d -> {cut_sql('d', max_len)})"
    )


def base64_texts_sql(text: str, min_len: int = 8, max_len: int | None = None) -> str:
    runs = f"regexp_extract_all({text}, {sql_str(BASE64_RUN)}, 0)"
    padded = "try_to_binary(concat(s, repeat('=', pmod(-length(s), 4))), 'base64')"
    return _decoded_array(runs, padded, "true", min_len, max_len)


def hex_texts_sql(text: str, min_len: int = 8, max_len: int | None = None) -> str:
    runs = f"regexp_extract_all({text}, {sql_str(HEX_RUN)}, 0)"
    return _decoded_array(runs, "unhex(s)", "length(s) % 2 = 0", min_len, max_len)


_UNICODE_RE = re.compile(UNICODE_RUN)


def _unescape_runs(t: str) -> str | None:
    # A run of \\uXXXX is UTF-16 in hexadecimal; surrogates without a partner cannot be stored and go.
    out = _UNICODE_RE.sub(lambda run: bytes.fromhex(run[0].replace("\\u", "")).decode("utf-16-be", "ignore"), t)
    return None if out == t else out


def _unquote(t: str) -> str | None:
    out = unquote(t)
    return None if out == t else out


@udf(_WHOLE, useArrow=False)
def decode_whole_text(t: str | None) -> tuple[str | None, str | None] | None:
    """URL and ``\\uXXXX`` decoding of a text (NULL where nothing changes).

    Neither has an equivalent built-in: ``url_decode`` turns ``+`` into a space and fails
    on malformed escapes. Callers pass NULL for texts that hold no escape at all.
    """
    if t is None:
        return None
    return (_unquote(t) if "%" in t else None, _unescape_runs(t) if _UNICODE_RE.search(t) else None)


# ---- measures --------------------------------------------------------------------------
def shannon_entropy(c) -> Column:
    """Bits per character, folded over the distinct characters of the value."""
    c = _c(c)
    n = F.length(c).cast("double")
    return F.aggregate(
        F.array_distinct(F.split(c, "")),
        F.lit(0.0),
        lambda acc, ch: acc
        - F.when(ch == "", F.lit(0.0)).otherwise(
            (n - F.length(F.replace(c, ch))) / n * F.log2((n - F.length(F.replace(c, ch))) / n)
        ),
    )


def sha16(c) -> Column:
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def content_hash(detector, ftype, value) -> Column:
    """Storage key of a finding: hash over detector, type and the value's hash."""
    return sha16(F.concat_ws("|", _c(detector), _c(ftype), sha16(value)))


def hmac_sha256(key: bytes, c) -> Column:
    """HMAC-SHA256 as hex, composed from ``sha2``; the two pads are literals."""
    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    ipad, opad = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    inner = F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(_c(c), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(opad)), F.unhex(inner)), 256)


def project_name(c) -> Column:
    """Last path component, by slash if there is one, else by backslash."""
    c = _c(c)
    return F.when(F.contains(c, F.lit("/")), F.element_at(F.split(c, "/"), -1)).otherwise(
        F.element_at(F.split(c, r"\\"), -1)
    )


def like_contains(c, needle: str) -> Column:
    """Literal substring test (the LIKE wildcards of the needle have no meaning)."""
    return F.contains(_c(c), F.lit(needle))


# ---- globs (driver side: patterns come from configuration) ------------------------------
def glob_regex(globs: Iterable[str]) -> str | None:
    """One anchored Java regex for a list of shell globs; None when the list is empty."""
    parts = []
    for g in globs:
        out, i = "", 0
        while i < len(g):
            ch = g[i]
            end = g.find("]", i + 2) if ch == "[" else -1
            if ch == "*":
                out += ".*"
            elif ch == "?":
                out += "."
            elif ch == "[" and end > 0:
                body = g[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += "[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^", 1) if body[0] == "^" else body) + "]"
                i = end
            else:
                out += re.escape(ch)
            i += 1
        parts.append(out)
    return r"(?s)\A(?:" + "|".join(parts) + r")\z" if parts else None


def matches_glob(c, globs: Iterable[str]) -> Column:
    rx = glob_regex(globs)
    return F.lit(False) if rx is None else _c(c).rlike(rx)
