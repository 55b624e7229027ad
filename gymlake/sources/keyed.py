"""Keyed writes on a stored table.

The table lies in buckets of its key (one folder each).  A write first finds the buckets that its
keys fall in (at most ``buckets`` numbers), reads only those, applies the change and replaces them
by dynamic partition overwrite; all other buckets are neither read nor written.  Spark writes the
new files aside and swaps them in at commit.  A change that is run again after a failure gives
the same table, as long as its operator does (upserts, patches and deletes by key do).

Each bucket holds one marker row, so that a bucket whose last row is deleted is replaced too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.operators.upserts import guarded_delete, update_rows, upsert
from gymlake.session import checkpoint_dir

BUCKET, MARKER = "_bucket", "_marker"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class KeyedTable:
    """A table at ``path`` in ``buckets`` folders by the hash of ``key`` (NULL keys have a bucket
    as well)."""

    def __init__(self, spark: SparkSession, path: str, key, schema, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.key = [key] if isinstance(key, str) else list(key)
        self.schema = schema

    @classmethod
    def create(cls, rows: DataFrame, path: str, key, buckets: int = 64) -> "KeyedTable":
        table = cls(rows.sparkSession, path, key, rows.schema, buckets)
        everywhere = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias(BUCKET))
        table._write(rows, everywhere, "errorifexists")
        return table

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        try:
            self._stored()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _stored(self) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{fields}, {MARKER} boolean, {BUCKET} int").parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of the named buckets only if they are given (partition pruning)."""
        rows = self._stored()
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(*buckets)) if buckets else rows.where("false")
        return rows.where(~F.col(MARKER)).select(*self.schema.names)

    def _write(self, rows: DataFrame, buckets: DataFrame, mode: str) -> None:
        placed = rows.select(*self.schema.names, F.lit(False).alias(MARKER), self.bucket().alias(BUCKET))
        markers = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields],
                                 F.lit(True).alias(MARKER), BUCKET)
        # a small bucket is one file; a large one is written by several tasks (a plain repartition
        # would leave it to one, however large)
        (placed.unionByName(markers).hint("rebalance", BUCKET)
         .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys of ``keys`` fall in: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket().alias(BUCKET)).distinct().collect())

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of ``keys`` by ``change(their rows)``; returns them.  ``change``
        must not move a row to another key."""
        buckets = self.touched(keys)
        if buckets:
            marked = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int")
            self._write(change(self.read(buckets)), marked, "overwrite")
        return buckets

    def upsert(self, updates: DataFrame, order_cols, keep_first=("created_at",)) -> list[int]:
        """Last write wins per key."""
        return self.rewrite(updates, lambda rows: upsert(rows, updates, self.key, order_cols, keep_first))

    def patch(self, patches: DataFrame, allowed: dict | None = None, order_col: str | None = None) -> list[int]:
        """Columns of matching rows get their last stated value."""
        return self.rewrite(patches, lambda rows: update_rows(rows, patches, self.key, allowed, order_col))

    def delete(self, keys: DataFrame, owner: str | None = None) -> list[int]:
        """Rows of the named keys go; with ``owner`` only where it names the row's owner."""
        if owner:
            return self.rewrite(keys, lambda rows: guarded_delete(rows, keys, self.key, owner))
        return self.rewrite(keys, lambda rows: rows.join(keys.select(*self.key).distinct(), self.key, "left_anti"))
