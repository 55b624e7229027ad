"""Report and append sinks.

Writes are plain DataFrame writers (task-parallel, commit protocol handled by
Spark), so a lost executor only re-runs its tasks.  An empty report still
carries its header/schema: Spark writes one header-only file for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# RFC 4180 quoting, the same on both sides: a quote inside a field is doubled, and
# fields may hold line breaks.  CSV has one form for both an empty and a missing text:
# they come back as missing.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the default format keeps milliseconds only
CSV = {"header": True, "timestampNTZFormat": _MICROS, "timestampFormat": _MICROS + "XXX",
       "quote": '"', "escape": '"', "nullValue": ""}


def write_report(df: DataFrame, path: str, fmt: str = "csv", partition_by=None) -> None:
    """Overwrite a report at ``path`` (CSV with header, or Parquet)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.options(**CSV).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported report format {fmt!r} (xlsx is not built)")


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV report of ``write_report``, with its quoting and line breaks."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def append(df: DataFrame, path: str, partition_by: str | None = "log_date") -> None:
    """Append rows to a Parquet table, partitioned by date so readers prune.  Rows of a
    partition are brought together first (AQE splits a large one again), so the table
    gets a file per partition and not one per task and partition."""
    if partition_by and partition_by in df.columns:
        w = df.hint("rebalance", partition_by).write.mode("append").partitionBy(partition_by)
    else:
        w = df.write.mode("append")
    w.parquet(path)
