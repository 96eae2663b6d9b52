"""Session helpers: settings this package relies on, input spreading, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the job brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName("dredgeline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Repartition an input whose splits are fewer than the cores that could work on it.

    A regex scan is CPU-bound, so a table that arrives as a handful of row groups must be
    spread before it. Inputs that already have enough splits pass unchanged: no shuffle at
    cluster scale. (A split without a row group counts as a split, hence ``min_partitions``.)
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = min_partitions or cores
    # Two tasks per core even out texts of very different length.
    return df.repartition(max(want, 2 * cores)) if df.rdd.getNumPartitions() < want else df


def local_mode(master: str) -> bool:
    """All in one process; local-cluster is not."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared ``spark.checkpoint.dir``; a temporary folder only in local mode, where all share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not local_mode(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
