"""Shared helpers: tables in the shared folder, size-checked broadcasts, components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.session import checkpoint_dir

# A key set is broadcast only up to this many rows (about 16 bytes each, so under
# 32 MB on the wire); a larger one goes through a shuffled join.
BROADCAST_ROWS = 2_000_000


# Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts vary from nothing to megabytes: bound Arrow batches by bytes, not only by rows
    (10,000 long texts would not fit beside a small executor's heap)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files) of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the written
    table, so a lost executor costs a re-read and not a re-computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint when its measured ``rows`` are within ``limit``."""
    return F.broadcast(small) if rows <= limit else small


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a file scan, filtered or projected at most: a join or an explode would
    give several rows the place of one."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every row and ``tag``, a number that stays with the row in every scan.

    A row of a file scan is numbered by its file and its place in it.  (The numbers of
    monotonically_increasing_id follow how files are cut into tasks, which may differ from one
    job to the next.)  Rows from anything else are numbered once and stored.
    """
    placed = None
    if _is_scan(docs):
        try:
            placed = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:  # a format without row places
            pass
    if placed is None:
        return stored(docs.select(*columns, F.monotonically_increasing_id().alias("tag")), "numbered")
    # one row per file
    files = stored(placed.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file"))), "files")
    return (placed.join(sized(files, files.count()), "_file")
            .select(*columns, (F.col("_number").cast("long") * (1 << 40) + F.col("_row")).alias("tag")))


def tidied(run):
    """A task function that gives freed memory back to the system at its end: Python workers
    are used again, and what they hold adds up beside the JVM of their executor."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph by minimum labels with pointer jumping.

    ``edges``: columns a, b (long, not null).  Returns node, label: the smallest node
    of its component.  Each round writes one (node, label) table to the shared folder;
    rounds go on until no label changes, so no size or diameter is cut off.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a != b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # smallest label among the neighbours ...
        near = (both.join(labels, both.b == labels.node)
                .groupBy("a").agg(F.min("label").alias("m")))
        step = (labels.join(near, labels.node == near.a)
                .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        # ... then the label of that label
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        jumped = (step.join(up, step.label == up.p, "left")
                  .select("node", "old", F.least("label", F.coalesce("pl", "label")).alias("label")))
        now = stored(jumped, f"{name}-{turn}")
        if now.where("label != old").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")
