"""The registered queries of this package, over whole tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from dredgeline.llm import bloom_lm, bpe, chat, filter_audit, fingerprints, jaccard_join, knn_quality, mixing, quality_rules, store, substring_dedup, token_files, topk, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i
         WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op3_quality_rules",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(line.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN line ON d.doc_id = line.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > word_chars
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM base
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


def with_conflict(turns: DataFrame) -> DataFrame:
    """The conversations, and one more whose texts are control strings of common templates."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionAll(more)


@query(
    "op8_chat_formatting",
    r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, contains(text, '<s>') OR contains(text, '</s>') AS bad FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 10 + CASE WHEN bad THEN length(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>')) ELSE length(text) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return chat.chat_report(with_conflict(table(spark, sf, "conversations")))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


@query(
    "op9_exact_topk",
    """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.r AS q, q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.r <> r.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
""",
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_files")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{store.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    file = vocabulary("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf, "documents"), path, partial(token_files.library_pieces, file), 50_257)
    return token_files.read_token_files(spark, path)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from public_tokenizers import PATTERN

    found = bpe.encode(table(spark, sf, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN, decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op10_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
walk(root, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT root, y FROM walk JOIN link ON node = x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM d JOIN walk ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_bloom_lm")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return bloom_lm.score_texts(table(spark, sf, "documents"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return knn_quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) < doc_id AS again FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN again THEN 'E' ELSE '' END AS fails,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM e LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[1:step - 1] AS done, filter_order[step:step] AS x FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, x,
  sum(CASE WHEN translate(fails, done || x, '') = fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN translate(fails, done, '') = fails AND contains(fails, x) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN translate(fails, done, '') <> fails AND contains(fails, x) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN translate(fails, done, '') = fails AND contains(fails, x) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN translate(fails, done, '') = fails AND contains(fails, x) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out as common table expressions."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min(far * {entries} + entry) % {entries} AS entry, min(far) AS far FROM (
  SELECT p.r, p.part, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS far FROM p JOIN c{k} c ON p.part = c.part) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
  SELECT a.part, a.entry, generate_subscripts(p.x, 1) AS i, unnest(p.x) AS y FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part) GROUP BY part, entry, i),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
  (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY part, entry) m ON c.part = m.part AND c.entry = m.entry)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM (SELECT *, unnest(range({parts})) AS part FROM v)),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries}),
{",".join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v USING (r), b
"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
