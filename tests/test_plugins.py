"""Hooks in place of defaults, hooks that fail, response chunks in any order, and stage metrics."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dredgeline.functions.clients import CLIENTS
from dredgeline.operators import detect
from dredgeline.plans import scan as jobs
from dredgeline.plans.metrics import StageMetrics, StreamMetrics, observed
from dredgeline.plans.plugins import Plugins
from dredgeline.streaming import chunks

KEY = "AKIA" + "Q7" * 8


def boom(*_):
    raise RuntimeError("broken hook\nwith a second line")


@pytest.fixture(scope="module")
def rules():
    return [r for r in detect.community_rules() if r.name == "aws_access_key"]


@pytest.mark.parametrize("bad", [boom, lambda *_: None, lambda t, *_: t.select("doc_id")])
def test_a_failing_redaction_falls_back(spark, rules, bad):
    texts = spark.createDataFrame([(1, f"a {KEY} b"), (2, "clean")], "doc_id int, text string")
    found = detect.scan(texts, rules, keep=["doc_id"]).withColumn("action", F.lit("redact"))
    plug = Plugins(redact=bad)
    got = {r.doc_id: r.text for r in jobs.redact_texts(texts, found, jobs.ScanConfig(plugins=plug), ["doc_id"]).collect()}
    assert got == {1: "a [REDACTED:aws_access_key] b", 2: "clean"}
    assert [f.hook for f in plug.failures] == ["redact"] and "\n" not in plug.failures[0].error


def test_other_hooks_fall_back(spark, rules):
    texts = spark.createDataFrame([(1, f"a {KEY} b"), (2, "clean")], "response_id int, text string")
    plug = Plugins(response_filter=boom, evaluate=boom, tool_policy=lambda c: F.col("no_such"), allowlist=boom, post_scan=[boom])
    cfg = jobs.ScanConfig(rules=rules, plugins=plug)
    assert jobs.scan_response_texts(texts, cfg).count() == 1
    calls = spark.createDataFrame([(1, "t", True)], "msg_no int, tool_name string, known boolean")
    none = spark.createDataFrame([], "msg_no int, type string")
    assert jobs.tool_call_verdicts(calls, none, cfg).first().status == "allowed"
    assert plug.run_evaluate(texts, lambda f: f.limit(1)).count() == 1
    assert jobs.finish(texts, cfg) is texts
    assert plug.run_allowlist(detect.scan(texts, rules, keep=["response_id"]), [], []).count() == 1
    assert [f.hook for f in plug.failures] == ["response_filter", "tool_policy", "evaluate", "post_scan", "allowlist"]


def test_extra_clients_come_last(spark):
    plug = Plugins()
    plug.register_clients([("mine", "Mine", "cli", "multi", ("mine/",))])
    assert plug.clients()[:-1] == CLIENTS and plug.clients()[-1][0] == "mine"


def responses():
    r = random.Random(8)
    texts = {}
    for i in range(12):
        words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(r.choice((0, 3, 60, 700)))]
        for _ in range(r.randint(0, 4)):
            words.insert(r.randint(0, len(words)), "AKIA" + "".join(r.choice("ABCDEFGH") for _ in range(16)))
        texts[i] = " ".join(words)
    texts[20] = "x" * 4000 + " " + KEY  # no white space to cut at
    return texts


def test_pieces_do_not_depend_on_the_chunks():
    """Any chunk size, order and repetition: the owned stretches are the text, and every key lies whole in one piece that owns its start."""
    texts, r = responses(), random.Random(9)

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, v):
            self.exists, self.get = True, v

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, _):
            pass

    for overlap in (64, 512):
        for i, text in texts.items():
            size = r.choice((1, 7, 100, 5000)) if len(text) < 3000 else r.choice((90, 900))
            parts = [text[k : k + size] for k in range(0, len(text), size)] or [""]
            rows = [(n, t, n == len(parts) - 1) for n, t in enumerate(parts)]
            rows += r.sample(rows, min(3, len(rows)))
            r.shuffle(rows)
            state, run, out = State(), chunks._pieces("response_id", overlap, None), []
            while rows:
                some, rows = rows[:9], rows[9:]
                if not state.exists and out and out[-1]["last"]:
                    break  # what comes after the end of a response would begin another
                frames = [pd.DataFrame(some[:4], columns=["chunk_no", "text", "last"]), pd.DataFrame(some[4:], columns=["chunk_no", "text", "last"])]
                out += [x for p in run((i,), iter(frames), state) for x in p.to_dict("records")]
            assert "".join(p["text"][p["own_from"] : p["own_to"]] for p in out) == text
            assert all(p["text"] == text[p["start"] : p["start"] + len(p["text"])] for p in out) and out[-1]["last"]
            for at in (k for k in range(len(text)) if text.startswith("AKIA", k)):
                owners = [p for p in out if p["start"] + p["own_from"] <= at < p["start"] + p["own_to"]]
                assert len(owners) == 1 and text[at : at + 20] in owners[0]["text"]


def test_metrics_of_a_job_and_of_a_stream(spark, tmp_path):
    seen = StageMetrics()
    df = seen.stage(spark.range(100), "read", largest=F.max("id"))
    seen.stage(df.where("id % 4 = 0"), "kept").collect()
    assert {(r.stage, r.measure): r.value for r in seen.table(spark).collect()} == {("read", "rows"): 100, ("read", "largest"): 99, ("kept", "rows"): 25}
    listener = StreamMetrics()
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            spark.range(10 * k, 10 * k + 5 + k).write.mode("append").parquet(f"{tmp_path}/in")
            stream = observed(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "read", least=F.min("id"))
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").queryName("numbers").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch, r.measure): r.value for r in listener.table(spark).collect()}
    assert [got[k, "rows"] for k in range(3)] == [5, 6, 7] and [got[k, "least"] for k in range(3)] == [0, 10, 20]


def test_cut_matches_in_the_context_do_not_count(spark):
    """Context that a piece's ends cut holds a shorter address, whose letters the own stretch holds too."""
    head, own, tail = "ser@example.org, ", "we write to user@example.org and bob@example.com, é ", "bob@example.co"
    text = head + own + tail
    rows = [(1, 0, 100, len(head), len(head + own), text, False)]
    pieces = spark.createDataFrame(rows, "response_id long, chunk_no int, start long, own_from int, own_to int, text string, last boolean")
    rules = [r for r in detect.community_rules() if r.name in ("email", "generic_password")]
    got = sorted((r["value"], r["position"]) for r in chunks.scan_pieces(pieces, rules).collect())
    assert got == [("bob@example.com", 100 + text.index("bob@")), ("user@example.org", 100 + text.index("user@"))]
