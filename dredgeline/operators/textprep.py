"""Text preparation: sanitise, decode, cap, budget. All narrow, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.functions import text as tx

MAX_SCAN_CHARS = 200_000
MAX_RESPONSE_CHARS = 1_048_576


def sanitize_frame(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.sanitize(col))


def cap(c, limit: int = MAX_RESPONSE_CHARS) -> Column:
    return F.substring(F.col(c) if isinstance(c, str) else c, 1, limit)


def oversized(body, limit: int) -> Column:
    """True for bodies that are not scanned but reported as a framework finding."""
    return F.octet_length(F.col(body) if isinstance(body, str) else body) > limit


def _children_sql(text: str, whole: str, base64: bool, hexa: bool, url: bool, esc: bool, min_len: int, max_len: int | None) -> str:
    """The decoded children of one text, as an array of (encoding, text)."""
    parts = []
    if base64:
        parts.append(f"transform({tx.base64_texts_sql(text, min_len, max_len)}, t -> struct('base64' as encoding, t as text))")
    if hexa:
        parts.append(f"transform({tx.hex_texts_sql(text, min_len, max_len)}, t -> struct('hex' as encoding, t as text))")
    for on, name, val in ((url, "url", f"{whole}.url"), (esc, "unicode", f"{whole}.esc")):
        if on:
            ok = f"length({val}) >= {min_len} AND length(regexp_replace({val}, '[^ -~]', '')) / length({val}) >= 0.7"
            parts.append(f"CASE WHEN {ok} THEN array(struct('{name}' as encoding, {tx.cut_sql(val, max_len)} as text)) "
                         "ELSE cast(array() as array<struct<encoding string, text string>>) END")
    return f"concat({', '.join(parts)})"


def decode_fields(
    df: DataFrame,
    text: str = "text",
    path: str | None = "path",
    max_depth: int = 2,
    base64: bool = True,
    hexa: bool = True,
    url: bool = True,
    esc: bool = True,
    min_len: int = 8,
    max_len: int | None = None,
    sanitize_decoded: bool = True,
) -> DataFrame:
    """Expand each text row to the raw text plus every decoded variant.

    Adds ``encoding`` and ``variant``, the position of the variant as an array: [] for the
    raw text, [j] for its j-th child, [j, k] below it; sorting by it gives depth-first order.
    Each level is one projection and one outer explode over the level before, so nothing is
    computed twice or shuffled. Only texts that hold an escape are sent to Python.
    """
    out = df.withColumn("encoding", F.lit("raw")).withColumn("variant", F.array().cast("array<int>"))
    rest = [c for c in df.columns if c != text]
    me = f"struct(encoding as encoding, {text} as text)"
    for k in range(max_depth if base64 or hexa or url or esc else 0):
        if url or esc:
            held = F.contains(text, F.lit("%")) | F.contains(text, F.lit("\\u"))
            out = out.withColumn("_whole", tx.decode_whole_text(F.when((F.size("variant") == k) & held, F.col(text))))
        kids = _children_sql(text, "_whole", base64, hexa, url, esc, min_len, max_len)
        out = out.withColumn("_all", F.expr(f"CASE WHEN size(variant) = {k} THEN concat(array({me}), {kids}) ELSE array({me}) END"))
        out = out.select(*rest, F.col("variant").alias("_up"), F.posexplode_outer("_all").alias("_j", "_x")).where("_x IS NOT NULL")
        out = out.select(*rest, F.col("_x.text").alias(text), F.col("_x.encoding").alias("encoding"),
                         F.expr("if(_j = 0, _up, concat(_up, array(_j - 1)))").alias("variant"))
    if sanitize_decoded:
        decoded = F.when(F.col("encoding") != "raw", F.col(text))
        out = out.withColumn(text, F.coalesce(tx.sanitize(decoded), F.col(text)))
    if path and path in df.columns:
        out = out.withColumn(
            path, F.when(F.col("encoding") == "raw", F.col(path)).otherwise(F.concat(path, F.lit("["), "encoding", F.lit("]")))
        )
    return out


def text_budget(fields: Column | str, limit: int = MAX_SCAN_CHARS, min_rest: int = 100) -> Column:
    """Newest-first character budget over one request's ``array<struct<..., text, ...>>``.

    Fields are visited last to first; the first that crosses the budget is cut to what is
    left when that exceeds ``min_rest``, and everything before it is dropped. Works inside
    the row: the running total is one fold over the lengths, so a request never shuffles.
    Returns the kept fields, newest first.
    """
    arr = f"reverse({fields})"
    sums = (
        f"aggregate({arr}, struct(cast(0 as bigint) as total, cast(array() as array<bigint>) as starts), "
        "(a, f) -> struct(a.total + length(f.text) as total, concat(a.starts, array(a.total)) as starts), a -> a.starts)"
    )
    cut = (
        f"CASE WHEN s + length(f.text) <= {limit} THEN f.text "
        f"WHEN s <= {limit} AND {limit} - s > {min_rest} THEN substr(f.text, 1, cast({limit} - s as int)) END"
    )
    zipped = f"zip_with({arr}, {sums}, (f, s) -> struct(f.path as path, {cut} as text, f.source_filename as source_filename))"
    # Later fields can only be kept while no earlier one crossed: a crossing pushes s past the limit.
    return F.expr(f"filter({zipped}, f -> f.text IS NOT NULL)")


def text_budget_rows(df: DataFrame, keys: list[str], order: str = "field_no", text: str = "text",
                     limit: int = MAX_SCAN_CHARS, min_rest: int = 100) -> DataFrame:
    """The same budget over exploded rows (a window per request)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.length(text).cast("bigint")
    upto = F.sum(n).over(w)
    start = upto - n
    out = df.withColumn("_upto", upto).withColumn("_start", start)
    out = out.withColumn(
        text,
        F.when(F.col("_upto") <= limit, F.col(text)).when(
            (F.col("_start") <= limit) & (limit - F.col("_start") > min_rest),
            F.substr(F.col(text), F.lit(1), (limit - F.col("_start")).cast("int")),
        ),
    )
    return out.where(F.col(text).isNotNull()).drop("_upto", "_start")


def budget_decoded(df: DataFrame, keys: Sequence[str], limit: int = MAX_SCAN_CHARS, min_rest: int = 100, text: str = "text") -> DataFrame:
    """The same budget over prepared rows: what was decoded counts like what was sent, and comes before it.

    Rows of a request must follow each other, newest field first, as exploding the reversed fields of a
    request and decoding them leaves them: both keep the order of rows. Inside a field the last
    variant comes first and the raw text last. A running total is carried from batch to batch, so
    nothing is shuffled or sorted, and a request of any length takes the memory of one field.
    """
    named = df.withColumn("_k", F.to_json(F.struct(*keys)))
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, key, total = None, None, 0

        def differs(column: pa.Array) -> np.ndarray:
            return np.concatenate(([True], pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)))

        def cut(t: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal key, total
            new_key = differs(t.column("_k"))
            first = np.flatnonzero(new_key | differs(t.column("field_no")))
            end = np.append(first[1:], len(t))
            t = t.take(pa.array(np.repeat(first + end - 1, end - first) - np.arange(len(t))))  # each field's rows the other way round
            n = pc.fill_null(pc.utf8_length(t.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, at = np.cumsum(n), np.flatnonzero(new_key)
            before = upto[at] - n[at]
            if t.column("_k")[0].as_py() == key:
                before[0] -= total
            upto -= np.repeat(before, np.diff(np.append(at, len(t))))
            key, total = t.column("_k")[len(t) - 1].as_py(), int(upto[-1])
            start = upto - n
            whole = upto <= limit
            part = ~whole & (start <= limit) & (limit - start > min_rest)
            t = t.select([f.name for f in schema])
            column = t.column(text)
            if part.any():
                values = column.to_pylist()
                for i in np.flatnonzero(part):
                    values[i] = values[i][: int(limit - start[i])]
                column = pa.array(values, column.type)
            t = t.set_column(t.schema.get_field_index(text), text, column)
            return t.filter(pa.array(whole | part))

        for batch in batches:
            t = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = np.flatnonzero(differs(t.column("_k")) | differs(t.column("field_no")))[-1] if len(t) else 0
            if last:
                yield cut(t.slice(0, last))
            rest = t.slice(last) if len(t) else None
        if rest is not None:
            yield cut(rest)

    return named.mapInArrow(run, schema)
