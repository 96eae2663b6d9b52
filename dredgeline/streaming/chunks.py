"""Responses that arrive in chunks: pieces that overlap their neighbours, so that nothing is lost at a chunk's border.

Per response the state holds the end of the text so far and the chunks that came too early. Every batch gives
at most one piece of a response: some text that was there before, and what is new as far as it follows
without a gap. A piece *owns* the positions from ``own_from`` to ``own_to``; the owned stretches of a response's
pieces follow each other and make up its whole text. What lies around them is context: a match that begins
in a piece's own stretch ends inside the piece if it has no more than ``overlap`` characters, so it
is found there and nowhere else, whatever the chunks' borders. The last owned position is moved back to white space where
there is some, so that owned stretches do not cut words.

Only strings are cut here. Scanning and rewriting of pieces is left to column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.functions import catalogue as cat
from dredgeline.functions import text as tx
from dredgeline.operators import detect
from dredgeline.streaming.state import KEEP_MS

OVERLAP = 512
STATE = "next int, start bigint, done int, text string, early string"
PIECE = "chunk_no int, start bigint, own_from int, own_to int, text string, last boolean"


def _cut(text: str, done: int, overlap: int, last: bool) -> int:
    """Where the owned stretch of a piece ends."""
    end = len(text) if last else max(done, len(text) - overlap)
    if last or end == done:
        return end
    space = max(text.rfind(c, done, end) for c in " \n\t\r")
    return space + 1 if space >= done else end


def _pieces(key: str, overlap: int, keep_ms: int | None):
    def run(who, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        no, start, done, text, early = state.get if state.exists else (0, 0, 0, "", "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for pdf in batches:  # a batch of a response is taken in slice by slice, not as one frame
            for n, t, end in zip(pdf["chunk_no"], pdf["text"], pdf["last"]):
                if n >= no:  # a chunk that comes again is dropped
                    waiting.setdefault(int(n), (t or "", bool(end)))
        new, last = [], False
        while no in waiting and not last:
            t, last = waiting.pop(no)
            new.append(t)
            no += 1
        if new:
            text += "".join(new)
            to = _cut(text, done, overlap, last)
            yield pd.DataFrame({key: [who[0]], "chunk_no": [no - 1], "start": [start], "own_from": [done], "own_to": [to], "text": [text], "last": [last]})
            left = max(0, to - overlap)
            text, start, done = text[left:], start + left, to - left
        if last:
            state.remove()
            return
        state.update((no, start, done, text, json.dumps(waiting)))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)

    return run


def pieces(chunks: DataFrame, key: str = "response_id", overlap: int = OVERLAP, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Pieces of a stream of (key, chunk_no, text, last): chunks are numbered from 0, ``last`` marks the end of a response.

    Chunks may come in any order and more than once. A response that never ends is given up after
    ``keep_ms`` without a chunk. Null text is empty.
    """
    schema = T.StructType([chunks.schema[key], *T._parse_datatype_string(PIECE)])
    timeout = "NoTimeout" if keep_ms is None else "ProcessingTimeTimeout"
    return chunks.select(key, "chunk_no", "text", "last").groupBy(key).applyInPandasWithState(_pieces(key, overlap, keep_ms), schema, STATE, "append", timeout)


def owned(found: DataFrame) -> DataFrame:
    """Pieces cut to the stretch they own: joined in the order of chunk_no, they are the response."""
    return found.withColumn("text", F.expr("substring(text, own_from + 1, own_to - own_from)")).drop("start", "own_from", "own_to")


def _start_sql(rule: detect.Rule, text: str) -> str:
    """Where match number ``match_no`` of the rule begins in the text, from 0: what lies between the matches, and they, are added up.

    The last alternative takes the rest of the text at once, which would else be tried from every place.
    """
    gaps = cat.JAVA_FLAGS + f"(?s:(.*?))(?:{detect.java_pattern(rule.pattern)})|(?s:.+)"
    total = lambda p, group, n: f"aggregate(slice(regexp_extract_all({text}, {tx.sql_str(p)}, {group}), 1, {n}), 0, (a, x) -> a + length(x))"
    return f"{total(gaps, 1, 'match_no + 1')} + {total(rule.java, 0, 'match_no')}"


def scan_pieces(found: DataFrame, rules: Sequence[detect.Rule], key: str = "response_id") -> DataFrame:
    """Findings in pieces whose match begins where the piece owns the text, with the match's place in the response.

    A match in the context around may be cut by the piece's ends; its value does not count, even if
    the piece's own stretch holds the same letters.
    """
    rules = list(rules)
    kept = [key, "chunk_no", "start", "own_from", "own_to", "piece"]
    hits = detect.scan(found.withColumn("piece", F.col("text")), rules, keep=kept)
    cases = " ".join(f"WHEN {i} THEN {_start_sql(r, 'piece')}" for i, r in enumerate(rules))
    hits = hits.withColumn("at", F.expr(f"CASE rule_no {cases} END") if rules else F.lit(0))
    mine = hits.where((F.col("at") >= F.col("own_from")) & (F.col("at") < F.col("own_to")))
    return mine.withColumn("position", F.col("start") + F.col("at")).drop("at", *kept[2:])
