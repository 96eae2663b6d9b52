"""Text, diff and log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as text; invalid UTF-8 becomes the replacement character, unreadable files are skipped."""
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
    )
    return df.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


# ---- unified diffs --------------------------------------------------------------------------
def _sections(diff: str, line_ends: str) -> tuple[str, str]:
    """SQL over a row: the lines of a diff, with the file that a header line names, and from those the sections.

    A section is a header's file, its number, and the lines up to the next header. The carry of a header over its
    lines is a slice between two headers, so it takes neither a window nor a shuffle.
    """
    lines = f"transform(split({diff}, {line_ends}), (l, i) -> struct(i as pos, regexp_extract(l, '\\\\A\\\\+\\\\+\\\\+ b/(.+)\\\\z', 1) as file, l as line))"
    sections = "transform(_h, (h, k) -> struct(h.file as file, k as section, slice(_l, h.pos + 2, coalesce(get(_h, k + 1).pos, size(_l)) - h.pos - 1) as lines))"
    return lines, sections


_IS_ADDED = "(l.line LIKE '+%' AND NOT l.line LIKE '+++%')"


def diff_files(diffs: DataFrame, key: str = "diff_id", diff: str = "diff") -> DataFrame:
    """Added text per file of a unified diff, all inside the row: only what was added leaves it.

    Lines before the first header, deletions and binary notices are ignored; a later
    section of the same file replaces the earlier one unless it adds nothing. Every row is a diff.
    """
    lines, sections = _sections(diff, r"'\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'")
    x = diffs.select(key, F.expr(lines).alias("_l")).withColumn("_h", F.expr("filter(_l, l -> l.file <> '')"))
    added = f"filter(transform({sections}, s -> struct(s.file as file, s.section as section, transform(filter(s.lines, l -> {_IS_ADDED}), l -> substr(l.line, 2)) as added)), s -> size(s.added) > 0)"
    x = x.select(key, F.expr(f"array_sort({added}, (a, b) -> CASE WHEN a.file < b.file THEN -1 WHEN a.file > b.file THEN 1 ELSE a.section - b.section END)").alias("_s"))
    # Of the sections of one file the last stands.
    x = x.select(key, F.explode_outer(F.expr("filter(_s, (s, i) -> coalesce(get(_s, i + 1).file <> s.file, true))")).alias("_f")).where("_f IS NOT NULL")
    return x.select(key, F.col("_f.file").alias("file"), F.array_join("_f.added", "\n").alias("text"))


def diff_lines(diffs: DataFrame, key: str = "diff_id", diff: str = "diff") -> DataFrame:
    """Line-level view: key, file, pos and added, a row for every added line, with the file of the header above it."""
    lines, sections = _sections(diff, r"'\\r?\\n'")
    x = diffs.select(key, F.expr(lines).alias("_l")).withColumn("_h", F.expr("filter(_l, l -> l.file <> '')"))
    x = x.select(key, F.explode_outer(F.expr(sections)).alias("_s")).where("_s IS NOT NULL")
    x = x.select(key, F.col("_s.file").alias("file"), F.explode_outer(F.expr(f"filter(_s.lines, l -> {_IS_ADDED})")).alias("_a")).where("_a IS NOT NULL")
    return x.select(key, "file", F.col("_a.pos").alias("pos"), F.substr("_a.line", F.lit(2)).alias("added"))


# ---- chunked responses --------------------------------------------------------------------------
def assemble_chunks(chunks: DataFrame, key: str = "response_id", order: str = "chunk_no", text: str = "text") -> DataFrame:
    """One text per response; a response is bounded by its size cap, as is its chunk list."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda c: c[text]), "").alias(text))
