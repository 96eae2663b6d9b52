"""Keyed streams whose micro-batches are joins and aggregates over the whole batch, for very many keys.

``state.py`` calls Python once for every key of a micro-batch, which costs about as much for one row as for
a thousand. Here a micro-batch is one job for all its keys, and what later batches have to know
is a table: every batch adds a folder of its own under ``state`` and reads those of the batches before. A batch
that is run again replaces its own folders only. Rows of a batch are taken in the order of event time, after
all of the batches before. State is kept for good, in as many folders as there were batches; only that of
responses in chunks is handed on whole from batch to batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.operators import dedup, tooling
from dredgeline.streaming.chunks import OVERLAP
from dredgeline.streaming.state import KEEP_MS, TTL_SECONDS

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _run(stream: DataFrame, path: str, checkpoint: str, step: Step, state: str):
    """``step(rows, state so far) -> (rows put out, state added)`` for each micro-batch; started, and ends when all is read."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [f"{path}/state/batch-{n}" for n in range(number)]
        held = spark.read.schema(state).parquet(*before) if before else spark.createDataFrame([], state)
        out, added = step(batch, held)
        out.write.mode("overwrite").parquet(f"{path}/out/batch-{number}")
        added.write.mode("overwrite").parquet(f"{path}/state/batch-{number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_out(spark, path: str) -> DataFrame:
    """What all batches put out."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")


def finding_ttl(stream: DataFrame, path: str, checkpoint: str, ttl_seconds: int = TTL_SECONDS):
    """Findings (id, ts, detector, type, value_hash, session_id) not within the TTL of the last equal one that was put out.

    A finding put out before rules out what lies less than a TTL after it; what is left of a batch is
    decided by :func:`dedup.finding_ttl`. Rows without a session pass.
    """
    keys, ttl = ["detector", "type", "value_hash", "session_id"], int(ttl_seconds * 1_000_000)

    def step(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = batch.agg(F.min(_us("ts"))).first()[0]
        alive = held.where(F.col("until") > (least or 0)).groupBy("k").agg(F.max("until").alias("until"))
        named = batch.withColumn("k", F.to_json(F.struct(*keys)))
        free = named.join(alive, "k", "left").where((F.col("session_id") == "") | F.col("until").isNull() | (_us("ts") >= F.col("until")))
        kept = dedup.finding_ttl(free.select(*batch.columns), value="value_hash", ttl_seconds=ttl_seconds)
        return kept, kept.where("session_id <> ''").select(F.to_json(F.struct(*keys)).alias("k"), (_us("ts") + ttl).alias("until"))

    return _run(stream, path, checkpoint, step, "k string, until long")


def text_dedup(stream: DataFrame, path: str, checkpoint: str, ttl_seconds: int = TTL_SECONDS):
    """Adds ``skipped`` to (req_id, ts, session_id, text_hash, action, stripped): an earlier request of the session's epoch committed the text.

    An epoch ends with idle time above the TTL and is named by its first instant; the first of a batch may go on
    with the one that the session was in. Rows without a session are never skipped.
    """
    ttl = int(ttl_seconds * 1_000_000)
    who = ["session_id", "_start"]

    def step(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        x = batch.withColumn("_us", _us("ts"))
        in_session = x.where("session_id <> ''")
        least = in_session.agg(F.min("_us")).first()[0]
        reqs = in_session.groupBy("session_id", "req_id").agg(F.min("_us").alias("_us"))
        reqs = dedup.islands(reqs, ["session_id"], "_us", ttl)
        last = held.where(F.col("text_hash").isNull() & (F.col("last") >= (least or 0) - ttl)).groupBy("session_id").agg(F.max_by("_start", "last").alias("_open"), F.max("last").alias("last"))
        stretches = reqs.groupBy("session_id", "island").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last")).join(last, "session_id", "left")
        goes_on = (F.col("island") == 1) & (F.col("_first") - F.col("last") <= ttl)
        stretches = stretches.select("session_id", "island", "_last", F.when(goes_on, F.col("_open")).otherwise(F.col("_first")).alias("_start"))
        x = x.join(reqs.join(stretches, ["session_id", "island"]).select("session_id", "req_id", "_start"), ["session_id", "req_id"], "left")
        at = F.struct("_us", "req_id")
        commits = ~F.col("action").isin("block", "redact") | ((F.col("action") == "block") & F.col("stripped"))
        first = x.where(F.col("_start").isNotNull() & commits).groupBy(*who, "text_hash").agg(F.min(at).alias("_commit"))
        known = held.where(F.col("text_hash").isNotNull()).select(*who, "text_hash", F.lit(True).alias("_known")).distinct()
        out = x.join(first, [*who, "text_hash"], "left").join(known, [*who, "text_hash"], "left")
        out = out.withColumn("skipped", F.coalesce("_known", F.col("_commit") < at, F.lit(False))).select(*batch.columns, "skipped")
        none = F.lit(None)
        added = first.select(*who, "text_hash", none.cast("long").alias("last"))
        return out, added.unionByName(stretches.select(*who, none.cast("string").alias("text_hash"), F.col("_last").alias("last")))

    return _run(stream, path, checkpoint, step, "session_id string, _start long, text_hash string, last long")


def unsolicited(stream: DataFrame, path: str, checkpoint: str):
    """Responses of (msg_no, ts, session_id, direction, msg_id) with ``valid``, as :func:`tooling.unsolicited` has it.

    Ids that still wait for their response come before a batch as requests, and so does one with an id
    of its own for a session that has sent anything.
    """
    begun = "\0begun"

    def step(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        pending = held.groupBy("session_id", "msg_id").agg(F.max_by("direction", "turn").alias("direction")).where("direction = 'out'")
        null = lambda c: F.lit(None).cast(batch.schema[c].dataType).alias(c)
        first = {"session_id": F.col("session_id"), "direction": F.col("direction"), "msg_id": F.col("msg_id"), "ts": F.timestamp_micros(F.lit(-(2**55))).cast(batch.schema["ts"].dataType).alias("ts")}
        before = pending.select(*(first.get(c, null(c)) for c in batch.columns))
        out = tooling.unsolicited(before.unionByName(batch))
        some = batch.where(F.col("msg_id").isNotNull())
        turn = (held.agg(F.max("turn")).first()[0] or 0) + 1
        added = some.groupBy("session_id", "msg_id").agg(F.max_by("direction", F.struct("ts", "msg_no")).alias("direction"))
        sent = some.where("direction = 'out'").select("session_id", F.lit(begun).alias("msg_id"), "direction").distinct()
        return out, added.unionByName(sent).withColumn("turn", F.lit(turn).cast("long"))

    return _run(stream, path, checkpoint, step, "session_id string, msg_id string, direction string, turn long")


def tool_binding(stream: DataFrame, path: str, checkpoint: str):
    """Calls of (msg_no, ts, session_id, kind, tool_name, tool_names) with ``known``: the first list of a session fixes its inventory."""

    def step(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = F.struct("ts", "msg_no")
        first = batch.where("kind = 'list'").groupBy("session_id").agg(F.min_by(F.coalesce("tool_names", F.array().cast("array<string>")), at).alias("_new"), F.min(at).alias("_at"))
        first = first.join(held.select("session_id"), "session_id", "left_anti")
        calls = batch.where("kind <> 'list'").join(held, "session_id", "left").join(first, "session_id", "left")
        listed = lambda c: F.coalesce(F.array_contains(c, F.col("tool_name")), F.lit(False))
        known = F.when(F.col("tools").isNotNull(), listed("tools")).when(at > F.col("_at"), listed("_new")).otherwise(F.lit(True))
        return calls.withColumn("known", known).select(*batch.columns, "known"), first.select("session_id", F.col("_new").alias("tools"))

    return _run(stream, path, checkpoint, step, "session_id string, tools array<string>")


#: A response after a batch: the chunk it waits for, its last piece and the chunks that came too early.
_RESPONSE = "next int, start bigint, own_from int, own_to int, text string, last boolean, fresh boolean, early array<struct<no int, late int, text string, last boolean>>, seen bigint"


def _piece_steps(overlap: int) -> list[dict[str, str]]:
    """Columns, step by step, that take the chunks of a batch (``came``) and a response's row of the batch before (``s``) to its next row."""
    space = ", ".join(f"length(substring_index(_r, '{c}', -1))" for c in (" ", "\\n", "\\t", "\\r"))
    return [
        {"_next": "coalesce(s.next, 0)", "_left": f"greatest(0, coalesce(s.own_to, 0) - {overlap})"},
        # Of chunks with one number the one that came first counts.
        {"_all": "array_sort(concat(coalesce(s.early, cast(array() as array<struct<no int, late int, text string, last boolean>>)), filter(came, c -> c.no >= _next)))"},
        {"_all": "filter(_all, (c, i) -> i = 0 OR c.no <> _all[i - 1].no)"},
        {"_run": "filter(_all, (c, i) -> c.no = _next + i)"},
        {"_end": "array_min(transform(filter(_run, c -> c.last), c -> c.no))"},
        {"_run": "filter(_run, c -> _end IS NULL OR c.no <= _end)"},
        {"fresh": "size(_run) > 0", "last": "_end IS NOT NULL", "next": "_next + size(_run)", "_before": "coalesce(substring(s.text, _left + 1), '')"},
        {"text": "if(fresh, concat(_before, array_join(transform(_run, c -> c.text), '')), s.text)", "own_from": "if(fresh, coalesce(s.own_to, 0) - _left, s.own_from)",
         "start": "if(fresh, coalesce(s.start, 0) + _left, s.start)", "early": "filter(_all, c -> c.no >= next)"},
        # The owned stretch ends behind its last white space.
        {"_stop": f"if(last, length(text), greatest(own_from, length(text) - {overlap}))"},
        {"_r": "if(last, '', substring(text, own_from + 1, _stop - own_from))"},
        {"_word": f"least({space})"},
        {"own_to": "if(fresh, if(_word = length(_r), _stop, _stop - _word), s.own_to)", "seen": "coalesce(now, s.seen)"},
    ]


def response_pieces(stream: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], key: str = "response_id",
                    overlap: int = OVERLAP, keep_ms: int | None = KEEP_MS):
    """Pieces of a stream of (key, chunk_no, text, last), as :func:`chunks.pieces` has them; ``build`` says what of them is put out.

    A batch leaves one row for every response that has not ended: its last piece, of which the end is needed again,
    and what came too early. The next batch reads that folder only.
    """
    state = f"{T.StructType([stream.schema[key]]).toDDL()}, {_RESPONSE}"

    def run(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, int(time.time() * 1000)
        held = spark.read.schema(state).parquet(f"{path}/state/batch-{number - 1}") if number else spark.createDataFrame([], state)
        held = held.where(~F.col("last") & (F.lit(keep_ms is None) | (F.col("seen") >= now - (keep_ms or 0))))
        kept = F.struct(*(c for c in held.columns if c != key))
        chunk = F.struct(F.col("chunk_no").cast("int").alias("no"), F.lit(1).alias("late"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("last", F.lit(False)).alias("last"))
        rows = batch.select(key, chunk.alias("c"), F.lit(now).alias("now")).unionByName(held.select(key, kept.alias("s")), allowMissingColumns=True)
        x = rows.groupBy(key).agg(F.collect_list("c").alias("came"), F.first("s", ignorenulls=True).alias("s"), F.max("now").alias("now"))
        for step in _piece_steps(overlap):
            x = x.withColumns({name: F.expr(sql) for name, sql in step.items()})
        x = x.withColumn("early", F.expr("transform(early, c -> named_struct('no', c.no, 'late', 0, 'text', c.text, 'last', c.last))"))
        x.select(held.columns).write.mode("overwrite").parquet(f"{path}/state/batch-{number}")
        fresh = spark.read.schema(state).parquet(f"{path}/state/batch-{number}").where("fresh")
        pieces = fresh.select(key, (F.col("next") - 1).alias("chunk_no"), "start", "own_from", "own_to", "text", "last")
        build(pieces).write.mode("overwrite").parquet(f"{path}/out/batch-{number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
