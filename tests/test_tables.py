"""Queries on tables that are larger than the given ones, or that are folders of files."""

import os

import pytest
from check_oracle import TABLES, compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _tables(tmp_path, spark, **made):
    """The given tables in a folder, those of ``made`` written as folders of several files."""
    for t in TABLES:
        if t in made:
            made[t].repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def _duck(sf, **made):
    con = duck(SF)
    for t in made:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["r01_streaming_scan", "r07_live_event_feed"])
def test_streams_read_folders(spark, tmp_path, name):
    made = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    sf = _tables(tmp_path, spark, **made)
    assert compare(entry.queries()[name](spark, sf), _duck(sf, **made), entry.oracle_sql()[name]) is None


def test_audit_source_beyond_its_limit(spark, tmp_path):
    """The query asks for the newest 10,000 entries; sf0.01 holds just as many."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    made = {"events": e.crossJoin(spark.range(12)).selectExpr("event_id + id * 1000000 AS event_id", "ts", "user_id", "event_type", "value", "props")}
    sf = _tables(tmp_path, spark, **made)
    assert compare(entry.queries()["s10_audit_source"](spark, sf), _duck(sf, **made), entry.oracle_sql()["s10_audit_source"]) is None


@pytest.mark.parametrize("name", ["r02_streaming_finding_ttl", "r03_streaming_text_dedup", "r05_streaming_unsolicited", "r05_streaming_tool_binding"])
def test_keyed_streams_make_no_call_per_key(spark, tmp_path, monkeypatch, name):
    """A micro-batch is one job for all its keys: equal to the SQL, without the operators that run Python for every key."""
    from pyspark.sql import GroupedData

    def refused(*_args, **_kw):
        raise AssertionError("a call for every key")

    for way in ("applyInPandasWithState", "transformWithStateInPandas", "transformWithState"):
        monkeypatch.setattr(GroupedData, way, refused)
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


def test_state_of_keyed_streams_over_batches(spark, tmp_path):
    """A key's state reaches the batches after the next, and late rows do not put a finding out again."""
    from pyspark.sql import functions as F

    from dredgeline.streaming import batches

    rows = [(0, 0, "a", 1), (1, 0, "a", 2), (0, 1, "b", 3), (2, 40, "a", 4), (2, 20, "a", 5), (3, 61, "a", 6), (3, 0, "b", 7)]  # turn, second, key, id
    for turn, second, key, n in rows:
        one = spark.createDataFrame([(n, second, "d", "t", key, "s")], "id long, second long, detector string, type string, value_hash string, session_id string")
        one.select("id", F.timestamp_seconds("second").alias("ts"), "detector", "type", "value_hash", "session_id").write.mode("append").parquet(f"{tmp_path}/in/turn={turn}")
    schema = spark.read.parquet(f"{tmp_path}/in/turn=0").schema
    for turn in range(4):
        spark.read.parquet(f"{tmp_path}/in/turn={turn}").write.mode("append").parquet(f"{tmp_path}/fed")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/fed")
        batches.finding_ttl(stream, f"{tmp_path}/t", f"{tmp_path}/c", 30).awaitTermination()
    assert sorted(r["id"] for r in batches.read_out(spark, f"{tmp_path}/t").collect()) == [1, 3, 4]


@pytest.mark.parametrize("name", ["t02_nfkc", "t05_url_decode", "default_scan_requests"])
def test_whole_texts_go_to_python_in_small_batches(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
