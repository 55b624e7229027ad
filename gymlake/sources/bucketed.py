"""Raw tables stored in buckets of their join key, so that the largest join of every
nutrition report (order lines with their orders) needs no shuffle.

Both sides lie in the same number of buckets by order id, one file a bucket.  An order has few
lines, so no bucket is hot, whatever the members do; what is shuffled behind the join are partial
sums per member.  A table is written once (``store``) and can be attached by any later session
from its folder and its description (``attach``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gymlake.session import checkpoint_dir
from gymlake.sources.tables import Tables

# Join keys of the raw tables that are joined with each other on them.
BUCKET_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
ROWS_PER_BUCKET = 2_000_000


@dataclass(frozen=True)
class BucketedTable:
    """Where a stored table lies and how: all that another session needs to attach it."""

    name: str
    path: str
    key: str
    buckets: int
    columns: str  # "name type, ..."


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, least: int = 8) -> int:
    """Buckets for the larger side: a power of two, so sides stored at other times still nest."""
    n = least
    while n * rows_per_bucket < rows:
        n *= 2
    return n


def store(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> BucketedTable:
    """Write ``df`` in ``buckets`` buckets of ``key``.  The shuffle deals rows by the hash that
    names the buckets, so each bucket is one sorted file; NULL keys share a bucket, as any join or
    grouping on the key drops or joins them."""
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/bucketed-{name}-{uuid.uuid4().hex}"
    table = f"bucketed_{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return BucketedTable(table, path, key, buckets, columns)


def attach(spark: SparkSession, table: BucketedTable) -> DataFrame:
    """The stored table; declared first where this session's catalog does not know it."""
    if not spark.catalog.tableExists(table.name):
        spark.sql(f"CREATE TABLE {table.name} ({table.columns}) USING parquet "
                  f"CLUSTERED BY ({table.key}) SORTED BY ({table.key}) INTO {table.buckets} BUCKETS "
                  f"LOCATION '{table.path}'")
    return spark.table(table.name)


def store_raw(t: Tables, columns: dict[str, list[str]] | None = None,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, BucketedTable]:
    """Store the tables of ``BUCKET_KEYS`` (only the named ``columns``, if given) in one number of
    buckets, taken from the larger one's rows (a count that reads file footers only)."""
    raw = {name: t.get(name) for name in BUCKET_KEYS}
    buckets = bucket_count(max(df.count() for df in raw.values()), rows_per_bucket)
    return {name: store(df.select(*columns[name]) if columns else df, name, BUCKET_KEYS[name], buckets)
            for name, df in raw.items()}


class BucketedTables(Tables):
    """``Tables`` whose raw tables come from buckets where they are stored; every domain table
    derived from them joins without a shuffle of its facts."""

    def __init__(self, spark: SparkSession, root: str, stored: dict[str, BucketedTable]):
        super().__init__(spark, root)
        self._cache.update({name: attach(spark, table) for name, table in stored.items()})
