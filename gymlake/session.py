"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that every job relies on.  ANSI mode stays on (Spark 4 default):
# divisions go through try_divide, so a zero denominator is NULL, never an error.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "gymlake") -> SparkSession:
    """Return a session configured for these jobs.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; locally (tests, bench) we pin loopback networking.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (builder.master(master)
                   .config("spark.driver.host", "127.0.0.1")
                   .config("spark.driver.bindAddress", "127.0.0.1")
                   .config("spark.driver.memory", os.environ.get("GYMLAKE_DRIVER_MEM", "16g")))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not shuffle_partitions:
        size_shuffle_partitions(spark)
    return spark


# Shuffles start at this many tasks per executor core; AQE then coalesces small
# reducers (advisory 64 MB) and splits skewed ones, so over-provisioning is cheap
# while too few reducers spill or run out of memory.
TASKS_PER_CORE = 4


def cluster_cores(spark: SparkSession) -> int:
    """Executor cores the job may use: the dynamic-allocation ceiling if there is
    one (executors may not have registered yet), else the default parallelism."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        execs = int(conf.get("spark.dynamicAllocation.maxExecutors", "0") or 0)
        cores = int(conf.get("spark.executor.cores", "1"))
        if execs > 0:
            return execs * cores
    return spark.sparkContext.defaultParallelism


def size_shuffle_partitions(spark: SparkSession) -> int:
    """Unless the submit configuration names ``spark.sql.shuffle.partitions``, size
    it from the cluster (Spark's default of 200 would give 500 GB reducers on a
    100 TB join).  Scan splits stay at ``spark.sql.files.maxPartitionBytes``."""
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.sql.shuffle.partitions"):
        return int(conf.get("spark.sql.shuffle.partitions"))
    n = max(200, TASKS_PER_CORE * cluster_cores(spark))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset on a local master (tests) do we create a scratch folder
    of our own; on a cluster a machine-local folder would not survive the loss of
    the executor that wrote it, so an unset setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a shared folder (HDFS, S3, ...) "
                         "that every executor and the driver can reach")
    local = tempfile.mkdtemp(prefix="gymlake-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
