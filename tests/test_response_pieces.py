"""Responses in chunks, a micro-batch as one job."""

import random

from pyspark.sql import functions as F

from dredgeline.streaming import batches


def test_pieces_of_several_batches_make_up_the_responses(spark, tmp_path):
    """Chunks out of order, repeated and in several batches: the owned stretches are the text, and a piece holds each key it owns the start of."""
    r, key = random.Random(4), "AKIA" + "ABCD" * 4
    texts = {i: " ".join(r.choice((key, "é" * r.randint(1, 9), "w\n")) for _ in range(r.choice((1, 30, 300)))) for i in range(9)} | {20: "x" * 900 + key, 21: ""}
    turns = [[] for _ in range(4)]
    for i, text in texts.items():
        parts = [text[k:k + 37] for k in range(0, len(text), 37)] or [""]
        for n, t in enumerate(parts):
            turn = r.randint(0, 3) if n < len(parts) - 1 else 3
            turns[turn] += [(i, n, t, n == len(parts) - 1)] * r.randint(1, 2)
    schema = "response_id long, chunk_no int, text string, last boolean"
    for rows in turns:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        batches.response_pieces(stream, f"{tmp_path}/t", f"{tmp_path}/c", lambda p: p, overlap=64, keep_ms=None).awaitTermination()
    got = {}
    for p in batches.read_out(spark, f"{tmp_path}/t").orderBy("response_id", "chunk_no").collect():
        got.setdefault(p.response_id, []).append(p)
    assert set(got) == set(texts) and all(p[-1]["last"] for p in got.values())
    for i, text in texts.items():
        assert "".join(p.text[p.own_from:p.own_to] for p in got[i]) == text
        assert all(p.text == text[p.start:p.start + len(p.text)] for p in got[i])
        for at in (k for k in range(len(text)) if text.startswith("AKIA", k)):
            owners = [p for p in got[i] if p.start + p.own_from <= at < p.start + p.own_to]
            assert len(owners) == 1 and key in owners[0].text[at - owners[0].start:][:20]
    left = spark.read.parquet(f"{tmp_path}/t/state/batch-3")
    assert left.where(~F.col("last")).count() == 0
