"""The findings store: what a batch writes, replays, rewriting, failed writes, and the merged rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dredgeline.sources import findings_store as store

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, timestamp timestamp_ntz, content_hash string, session_id string, namespace_id int, severity string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, key, session="s", hours=0, severity="low"):
    return (i, T0 + dt.timedelta(hours=hours), key, session, 1, severity)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("rows/*/bucket=*/*.parquet")}


def test_a_small_batch_writes_only_its_buckets(spark, tmp_path):
    p = str(tmp_path)
    store.add(batch(spark, [row(i, f"h{i}") for i in range(400)]), p, buckets=32)
    before = files(tmp_path)
    store.add(batch(spark, [row(1000 + i, f"h{i}", hours=1) for i in range(4)]), p)
    after = files(tmp_path)
    assert {k: v for k, v in after.items() if k in before} == before  # nothing that stood was rewritten
    assert len({k.split("/")[2] for k in set(after) - set(before)}) <= 4
    got = {r.content_hash: (r.id, r.seen_count, r.timestamp) for r in store.read(spark, p).collect()}
    assert len(got) == 400 and got["h2"] == (2, 2, T0 + dt.timedelta(hours=1)) and got["h9"] == (9, 1, T0)
    assert store.read(spark, p, number=1).agg(F.sum("seen_count")).first()[0] == 400


def test_replayed_and_failed_batches_count_once(spark, tmp_path):
    p = str(tmp_path)
    for n in (0, 1, 1, 0, 2):
        store.add(batch(spark, [row(n, "h"), row(10 + n, "k", hours=n)]), p, batch_id=n)
    store.add(batch(spark, [row(99, "h")]), p, batch_id=0, writer="another")
    # A write that got no commit is not seen.
    batch(spark, [row(5, "h")]).withColumn("seen_count", F.lit(7).cast("long")).withColumn("bucket", F.lit("0")).write.partitionBy("bucket").parquet(f"{p}/rows/lost")
    assert sorted((r.content_hash, r.id, r.seen_count) for r in store.read(spark, p).collect()) == [("h", 0, 4), ("k", 10, 3)]
    assert "lost" in store.unused(spark, p) and "lost" in store.vacuum(spark, p) and not store.unused(spark, p)
    assert store.read(spark, p).count() == 2


def test_two_writers_cannot_make_one_commit(spark, tmp_path):
    p = str(tmp_path)
    store.add(batch(spark, [row(1, "h")]), p)
    commit = store.load(spark, p)
    with pytest.raises(RuntimeError):
        store._publish(spark, p, commit)
    assert store.load(spark, p, 1) == commit
    assert [f.name for f in tmp_path.glob("_commits/*") if not f.name.endswith(".crc")] == ["0000000001.json"]  # the draft is gone


def test_buckets_are_rewritten_alone(spark, tmp_path):
    p = str(tmp_path)
    store.add(batch(spark, [row(i, f"h{i}") for i in range(200)]), p, buckets=8)
    for n in range(3):
        store.add(batch(spark, [row(300 + n, "h7", hours=n + 1), row(400 + n, "", hours=n)]), p, most=3)
    commit = store.load(spark, p)
    spread = {b: len(f) for b, f in commit.folders.items() if not b.startswith(store.OWN)}
    assert max(spread.values()) == 1 and commit.number == 5  # the fourth folder of one bucket made it one
    assert len({f for b, f in ((b, f[0]) for b, f in commit.folders.items() if not b.startswith(store.OWN))}) == 2
    got = store.read(spark, p).where("content_hash = 'h7'").first()
    assert (got.id, got.seen_count, got.timestamp) == (7, 4, T0 + dt.timedelta(hours=3))
    assert store.read(spark, p).where("content_hash = ''").count() == 3


@pytest.mark.parametrize("most", [1, 2, 50])
def test_any_split_into_batches_gives_the_same_table(spark, tmp_path, most):
    r = random.Random(most)
    rows = [row(i, r.choice(["", "a", "b", "c", "d"]), r.choice(["", "s1", "s2"]), r.randrange(50), r.choice("xyz")) for i in range(120)]
    for n in range(6):
        store.add(batch(spark, rows[n * 20 : n * 20 + 20]), str(tmp_path), batch_id=n, buckets=4, most=most)
    want: dict = {}
    for n in range(6):
        for x in sorted(rows[n * 20 : n * 20 + 20], key=lambda x: (x[1], x[0])):
            key = (x[2], x[3]) if x[2] and x[3] else x[0]
            if key in want:  # the first that was stored stays, with the latest time
                first, seen = want[key]
                want[key] = ((first[0], max(first[1], x[1]), *first[2:]), seen + 1)
            else:
                want[key] = (x, 1)
    got = store.read(spark, str(tmp_path)).select("id", "timestamp", "content_hash", "session_id", "namespace_id", "severity", "seen_count").collect()
    assert sorted(map(tuple, got)) == sorted((*x, n) for x, n in want.values())


def test_no_table_and_no_rows(spark, tmp_path):
    assert store.read(spark, str(tmp_path / "none")) is None and store.unused(spark, str(tmp_path / "none")) == []
    store.add(batch(spark, []), str(tmp_path / "t"))
    assert store.read(spark, str(tmp_path / "t")).count() == 0
    store.add(batch(spark, [row(1, "h")]), str(tmp_path / "t"))
    assert store.read(spark, str(tmp_path / "t")).count() == 1 and store.compact(spark, str(tmp_path / "t")) == []
