"""A findings table that grows by small additions instead of being rewritten.

Rows fall by a hash of their key into buckets. A batch adds one folder with its own rows, already
merged among themselves; nothing that stands is touched. Readers merge a bucket's folders on the
key. Once a bucket is spread over ``most`` folders, that bucket alone is rewritten into one.

What counts is the last commit: a small file that names, for every bucket, the folders that hold its
rows, in order. A folder without a commit is invisible, so a failed or lost write leaves the table
as it was. A commit also keeps the last batch number of each writer; a batch that comes again after a
failure is recognised and adds nothing.

Rows with neither hash nor session never merge. They go by their id into buckets of their own and are
only ever appended.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.operators import dedup

#: Buckets of a new table and folders of a bucket before it is rewritten.
BUCKETS, MOST = 64, 8
OWN = "own-"
#: Column of the stored files: the commit that brought a key first.
SEQ = "_seq"


@dataclass
class Commit:
    number: int = 0
    buckets: int = BUCKETS
    schema: str = ""
    #: Folders of each bucket, oldest first. Keys are numbers as text, as in JSON; those of appended rows begin with OWN.
    folders: dict[str, list[str]] = field(default_factory=dict)
    #: Last batch of each writer.
    batches: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    hp, fs = _fs(spark, f"{path}/_commits")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(hp) if s.getPath().getName().endswith(".json")) if fs.exists(hp) else []


def load(spark: SparkSession, path: str, number: int | None = None) -> Commit:
    """The last commit, or an earlier one by its number; an empty one for a table that does not exist."""
    found = _commits(spark, path)
    if not found:
        return Commit()
    hp, fs = _fs(spark, f"{path}/_commits/{found[-1] if number is None else number:010d}.json")
    stream = fs.open(hp)
    try:
        return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, commit: Commit) -> None:
    """Write the commit under a name of its own, then give it its number; two writers cannot both get one."""
    hp, fs = _fs(spark, f"{path}/_commits/{commit.number:010d}.json")
    draft, _ = _fs(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(asdict(commit)).encode())
    finally:
        out.close()
    if fs.exists(hp) or not fs.rename(draft, hp):
        fs.delete(draft, False)
        raise RuntimeError(f"commit {commit.number} of {path} was made by another writer; run the batch again")


def _keyed() -> Column:
    return (F.col("content_hash") != "") & (F.col("session_id") != "")


def _placed(rows: DataFrame, buckets: int, row_id: str) -> DataFrame:
    key = F.pmod(F.xxhash64(*dedup.UPSERT_KEY), F.lit(buckets)).cast("string")
    own = F.concat(F.lit(OWN), F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("string"))
    return rows.withColumn("bucket", F.when(_keyed(), key).otherwise(own))


def _write(rows: DataFrame, path: str, buckets: int, row_id: str) -> tuple[str, list[str]]:
    """Rows as a new folder with a directory for each bucket; (folder, its buckets)."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    _placed(rows, buckets, row_id).write.partitionBy("bucket").parquet(f"{path}/rows/{name}")
    hp, fs = _fs(spark, f"{path}/rows/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(hp)]
    return name, [x.split("=", 1)[1] for x in found if x.startswith("bucket=")]


def _rows(spark: SparkSession, path: str, commit: Commit, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(commit.schema))
    paths = [f"{path}/rows/{f}/bucket={b}" for b in buckets for f in commit.folders[b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _merged(spark: SparkSession, path: str, commit: Commit, buckets: list[str], ts: str, row_id: str) -> DataFrame:
    return dedup.upsert(None, _rows(spark, path, commit, buckets), ts, row_id, order=(SEQ, ts, row_id))


def add(findings: DataFrame, path: str, ts: str = "timestamp", row_id: str = "id", batch_id: int | None = None, writer: str = "", buckets: int = BUCKETS, most: int = MOST) -> None:
    """Add a batch; afterwards buckets of over ``most`` folders are rewritten."""
    spark = findings.sparkSession
    before = load(spark, path)
    if batch_id is not None and before.batches.get(writer, -1) >= batch_id:
        return
    commit = Commit(before.number + 1, before.buckets if before.number else buckets, before.schema, {b: list(f) for b, f in before.folders.items()}, dict(before.batches))
    rows = dedup.upsert(None, findings, ts, row_id).withColumn(SEQ, F.lit(commit.number))
    if commit.schema:
        stored = T.StructType.fromJson(json.loads(commit.schema))
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in stored))
    else:
        commit.schema = rows.schema.json()
    name, touched = _write(rows, path, commit.buckets, row_id)
    for b in touched:
        commit.folders.setdefault(b, []).append(name)
    if batch_id is not None:
        commit.batches[writer] = batch_id
    _publish(spark, path, commit)
    if any(len(f) > most for b, f in commit.folders.items() if not b.startswith(OWN)):
        compact(spark, path, ts, row_id, most)


def compact(spark: SparkSession, path: str, ts: str = "timestamp", row_id: str = "id", most: int = 1) -> list[str]:
    """Rewrite the buckets that lie in over ``most`` folders, each into one; the names of those buckets."""
    before = load(spark, path)
    spread = sorted(b for b, f in before.folders.items() if len(f) > most and not b.startswith(OWN))
    if spread:
        name, _ = _write(_merged(spark, path, before, spread, ts, row_id), path, before.buckets, row_id)
        folders = before.folders | {b: [name] for b in spread}
        _publish(spark, path, Commit(before.number + 1, before.buckets, before.schema, folders, before.batches))
    return spread


def read(spark: SparkSession, path: str, ts: str = "timestamp", row_id: str = "id", number: int | None = None) -> DataFrame | None:
    """The merged table as of the last, or the given, commit. Buckets of one folder are read as they stand, without a shuffle."""
    commit = load(spark, path, number)
    if not commit.number:
        return None
    several = [b for b, f in commit.folders.items() if len(f) > 1 and not b.startswith(OWN)]
    plain = [b for b in commit.folders if b not in set(several)]
    out = _rows(spark, path, commit, plain)
    if several:
        out = out.unionByName(_merged(spark, path, commit, several, ts, row_id))
    return out.drop(SEQ)


def unused(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Folders that none of the last ``keep`` commits names: what rewriting and failed writes left behind."""
    hp, fs = _fs(spark, f"{path}/rows")
    if not fs.exists(hp):
        return []
    used = {f for n in _commits(spark, path)[-keep:] for names in load(spark, path, n).folders.values() for f in names}
    return sorted(x for x in (s.getPath().getName() for s in fs.listStatus(hp)) if x not in used)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the folders of :func:`unused`. No write may be under way, and readers of earlier commits lose their files."""
    gone = unused(spark, path, keep)
    for name in gone:
        hp, fs = _fs(spark, f"{path}/rows/{name}")
        fs.delete(hp, True)
    return gone
