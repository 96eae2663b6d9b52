"""Keyed stream operators: exact finding TTL, text dedup, rate limit, response and tool checks.

Each is one ``transformWithStateInPandas`` per key with bounded state and a time-to-live.
Batches are replayed in event-time order within a key. Late rows beyond the watermark are
dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 1800


def _rows(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    pdf = pd.concat(list(batches), ignore_index=True)
    return pdf.sort_values(by, kind="stable")


def _us(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


#: How long unused state is kept; None keeps it for good. A run that drains its input once
#: (``availableNow``) must pass None: processing-time expiry asks for a next batch forever.
KEEP_MS = 24 * 3600 * 1000


class _Processor(StatefulProcessor):
    keep_ms: int | None = KEEP_MS

    def close(self) -> None:
        pass


def _long(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType())])


def _valued(df: DataFrame, keys: list[str], step, state_schema: str, extra: T.StructField | None, keep_ms: int | None) -> DataFrame:
    """One small value per key: ``step(pdf, state) -> (pdf, state)`` over time-ordered rows.

    ``applyInPandasWithState`` ships the value next to the rows, which suits very many keys
    better than state calls from Python do.
    """
    schema = T.StructType(df.schema.fields + ([extra] if extra else []))

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf, new = step(_rows(batches, ["ts", "id"]), state.get if state.exists else None)
        state.update(new)
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pdf

    timeout = "NoTimeout" if keep_ms is None else "ProcessingTimeTimeout"
    return df.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", timeout)


class TextDedup(_Processor):
    """Mark texts an earlier, committed request of the session already carried."""

    def __init__(self, columns: list[str], ttl_seconds: int = TTL_SECONDS):
        self.columns, self.ttl = columns, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("h", T.StringType())]), _long("us"), ttlDurationMs=self.keep_ms)
        self.meta = handle.getValueState("meta", _long("us"), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "req_id", "field_no"])
        last = self.meta.get()[0] if self.meta.exists() else None
        skipped = []
        for _, req in pdf.groupby(["ts", "req_id"], sort=False):
            us = _us(req["ts"].iloc[0])
            if last is not None and us - last > self.ttl:
                self.seen.clear()
            last = us
            old = [self.seen.containsKey((h,)) for h in req["text_hash"]]
            skipped += old
            action, stripped = req["action"].iloc[0], bool(req["stripped"].iloc[0])
            if action not in ("block", "redact") or (action == "block" and stripped):
                for h, was in zip(req["text_hash"], old):
                    if not was:
                        self.seen.updateValue((h,), (us,))
        self.meta.update((last,))
        yield pdf.assign(skipped=skipped)[[*self.columns, "skipped"]]


class ResponseTracker(_Processor):
    """Flag responses whose id was never sent; ids serve once."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", T.StructType([T.StructField("id", T.StringType())]), _long("n"), ttlDurationMs=self.keep_ms)
        self.seeded = handle.getValueState("seeded", _long("n"), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "msg_no"])
        sent = self.seeded.exists()
        valid = []
        for direction, mid in zip(pdf["direction"], pdf["msg_id"]):
            if mid is None or pd.isna(mid):
                valid.append(True)
            elif direction == "out":
                self.pending.updateValue((mid,), (1,))
                sent = True
                valid.append(True)
            elif not sent:
                valid.append(True)
            else:
                hit = self.pending.containsKey((mid,))
                if hit:
                    self.pending.removeKey((mid,))
                valid.append(bool(hit))
        if sent:
            self.seeded.update((1,))
        yield pdf.assign(valid=valid)[[*self.columns, "valid"]]


class ToolBinding(_Processor):
    """First tool list of a session fixes its inventory; later calls are checked against it."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tools = handle.getMapState("tools", T.StructType([T.StructField("name", T.StringType())]), _long("n"), ttlDurationMs=self.keep_ms)
        self.bound = handle.getValueState("bound", _long("n"), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "msg_no"])
        known = []
        for kind, name, names in zip(pdf["kind"], pdf["tool_name"], pdf["tool_names"]):
            if kind == "list":
                if not self.bound.exists():
                    for t in names if names is not None else []:
                        self.tools.updateValue((t,), (1,))
                    self.bound.update((1,))
                known.append(True)
            else:
                known.append(not self.bound.exists() or bool(self.tools.containsKey((name,))))
        yield pdf.assign(known=known)[[*self.columns, "known"]]


def _apply(df: DataFrame, keys: list[str], proc: _Processor, extra: T.StructField | None, keep_ms: int | None) -> DataFrame:
    schema = T.StructType(df.schema.fields + ([extra] if extra else []))
    proc.keep_ms = keep_ms
    mode = "None" if keep_ms is None else "ProcessingTime"
    return df.groupBy(*keys).transformWithStateInPandas(proc, schema, outputMode="Append", timeMode=mode)


def _flag(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def finding_ttl(df: DataFrame, ttl_seconds: int = TTL_SECONDS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Exact stream form over (id, ts, detector, type, value_hash, session_id): emit a finding
    unless an equal one was *emitted* within the TTL. Rows without a session bypass the state."""
    ttl, columns = ttl_seconds * 1_000_000, df.columns

    def step(pdf, state):
        last = state[0] if state else None
        keep = []
        for ts in pdf["ts"]:
            us = _us(ts)
            keep.append(last is None or us - last >= ttl)
            if keep[-1]:
                last = us
        return pdf.loc[keep, columns], (last,)

    keys = ["detector", "type", "value_hash", "session_id"]
    keyed = _valued(df.where("session_id <> ''"), keys, step, "us bigint", None, keep_ms)
    return keyed.unionByName(df.where("session_id = ''"))


def text_dedup(df: DataFrame, ttl_seconds: int = TTL_SECONDS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    return _apply(df, ["session_id"], TextDedup(df.columns, ttl_seconds), _flag("skipped"), keep_ms)


def rate_limit(df: DataFrame, capacity: int, refill_seconds: float, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Admit framework findings at a bounded rate per (detector, type); others always pass."""
    rate, columns = capacity / (refill_seconds * 1_000_000), df.columns

    def step(pdf, state):
        last, tokens = state if state else (None, float(capacity))
        admit = []
        for ts in pdf["ts"]:
            us = _us(ts)
            if last is not None:
                tokens = min(float(capacity), tokens + max(us - last, 0) * rate)
            last = us
            admit.append(tokens >= 1.0)
            tokens -= 1.0 if admit[-1] else 0.0
        return pdf.assign(admitted=admit)[[*columns, "admitted"]], (last, tokens)

    limited = _valued(df.where("origin = 'framework'"), ["detector", "type"], step, "us bigint, tokens double", _flag("admitted"), keep_ms)
    return limited.unionByName(df.where("origin <> 'framework'").withColumn("admitted", F.lit(True)))


def unsolicited(df: DataFrame, keep_ms: int | None = KEEP_MS) -> DataFrame:
    return _apply(df, ["session_id"], ResponseTracker(df.columns), _flag("valid"), keep_ms)


def tool_binding(df: DataFrame, keep_ms: int | None = KEEP_MS) -> DataFrame:
    return _apply(df, ["session_id"], ToolBinding(df.columns), _flag("known"), keep_ms)


def live_counters(findings: DataFrame, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rule hits per window; rows later than the watermark are dropped."""
    return findings.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "type").agg(F.count("*").alias("hits")).select(
        F.col("w.start").alias("window_start"), "type", "hits")


def upsert_stream(df: DataFrame, path: str, checkpoint: str, hmac_key: bytes = b"", ts: str = "timestamp"):
    """``foreachBatch`` merge into a findings store; replayed batches count once."""
    from dredgeline.sources.stores import write_findings

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_findings(batch, path, hmac_key, ts, batch_id)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_events(findings: DataFrame) -> DataFrame:
    """Feed of finding events, one per new finding; no raw value."""
    return findings.select(F.lit("finding").alias("event"), "req_id", "detector", "type", "severity", "location", "action", "value_preview")
