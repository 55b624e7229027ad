"""Structured Streaming jobs for the reference's write paths.

* T1 running day totals per member: a stateful aggregate (RocksDB state store) in update
  mode; each micro-batch gives the new totals of the (member, day) keys that it changed,
  which replace the old ones in a keyed sink.  No row is late: a log of any day counts
  whenever it arrives.
* T2 last-write-wins availability slots (X10), kept the same way.
* T3 booking stream: in arrival order, each micro-batch is validated (X7) against
  history plus every request accepted by earlier batches; a redelivered request
  (same id) is booked once.

The sinks of T1 and T2 are bucketed by key and hold one row per key, however many batches
came; a replayed micro-batch gives the same totals from the same state version, so writing
it again changes nothing.  The sink of T3 is partitioned by the micro-batch id and written
with dynamic partition overwrite, so a replayed micro-batch replaces exactly its own
partitions.  Table and checkpoint paths follow from the stream's name, the version of its
rules and its input, so a job that is started again resumes where it stopped, and one with
changed rules (``RULES``) starts anew instead of handing out what an older rule stored.  Both live under the cluster's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.operators.bookings import validate_bookings
from gymlake.operators.nutrition import MACROS
from gymlake.session import checkpoint_dir
from gymlake.sources.keyed import KeyedTable

# Version of each stream's rules and sink layout: raise it with a change of either.
RULES = {"daily_nutrition": 2, "availability": 2, "bookings": 2}
SINK_BUCKETS = 16
SLOT_KEY = ["user_id", "user_type", "slot_date", "hour"]


def stream_paths(spark: SparkSession, name: str, source: str) -> tuple[str, str]:
    """(output table path, checkpoint path) of a named stream over ``source`` (any text that
    tells inputs apart, such as the table's path): the same on every start."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-v{RULES.get(name, 1)}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    return f"{base}/table", f"{base}/checkpoint"


def write_batch(batch: DataFrame, out_path: str, batch_id: int, by: str | None = None) -> None:
    """Idempotent micro-batch sink: (re)writes only the partitions ``_batch = batch_id``,
    within each value of ``by``."""
    (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*([by] if by else []), "_batch").parquet(out_path))


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sink table (columns of ``schema`` and ``_batch``); empty before the first batch."""
    full = f"{schema}, _batch int"
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def _run(df: DataFrame, out_path: str, ckpt: str, transform, by: str | None = None, available_now: bool = True):
    def write(batch: DataFrame, batch_id: int):
        write_batch(transform(batch, batch_id), out_path, batch_id, by)

    w = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_keyed(changes: DataFrame, name: str, source: str, key: list[str], schema: str, order: str) -> DataFrame:
    """Run a stateful aggregate ``changes`` (one row per key, update mode) into a keyed sink and
    return the sink: one row per key.  ``order`` grows with every change of a key."""
    spark = changes.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    out, ckpt = stream_paths(spark, name, source)
    empty = spark.createDataFrame([], schema)
    sink = KeyedTable(spark, out, key, empty.schema, SINK_BUCKETS)
    if not sink.exists():
        sink = KeyedTable.create(empty, out, key, SINK_BUCKETS)

    def write(batch: DataFrame, _batch_id: int):
        sink.upsert(batch.select(*empty.columns), [order], keep_first=())

    spark.conf.set(provider, ROCKSDB)
    try:
        (changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(provider, before)
    return sink.read()


# ---------------------------------------------------------------- T1
DAY_SCHEMA = ("member_id int, log_date date, " + ", ".join(f"{m} decimal(18,2)" for m in MACROS)
              + ", entries_count bigint")


def day_sums(logs: DataFrame) -> DataFrame:
    """Day totals per member."""
    return (logs.groupBy("member_id", F.to_date("created_at").alias("log_date"))
            .agg(*[F.sum(f"total_{m}").cast("decimal(18,2)").alias(m) for m in MACROS],
                 F.count(F.lit(1)).alias("entries_count")))


def run_daily_nutrition(logs: DataFrame, source: str) -> DataFrame:
    """Run T1 over the available input and return the totals so far."""
    return run_keyed(day_sums(logs), "daily_nutrition", source, ["member_id", "log_date"], DAY_SCHEMA, "entries_count")


# ---------------------------------------------------------------- T2
SLOT_SCHEMA = "user_id int, user_type string, slot_date date, hour int, is_available boolean, seq bigint"


def last_writes(updates: DataFrame) -> DataFrame:
    """The last write per slot."""
    return updates.groupBy(*SLOT_KEY).agg(*[F.max_by(c, "seq").alias(c) for c in ("is_available", "seq")])


def run_availability(updates: DataFrame, source: str) -> DataFrame:
    """Run T2: the write of the highest ``seq`` per slot over all batches."""
    return run_keyed(last_writes(updates.select(*SLOT_KEY, "is_available", "seq")), "availability", source, SLOT_KEY,
                     SLOT_SCHEMA, "seq")


# ---------------------------------------------------------------- T3
BOOKING_SCHEMA = ("request_id bigint, coach_id int, member_id int, session_date date, session_time string, "
                  "duration int, accepted boolean, reason string")


def run_bookings(requests: DataFrame, members: DataFrame, coaches: DataFrame,
                 member_coach: DataFrame, sessions: DataFrame, source: str) -> DataFrame:
    """Run T3: every micro-batch is validated (X7) against history plus the requests
    accepted by earlier batches; results are appended per batch.

    The sink is partitioned by session date, and history and sink are read for the
    batch's dates only, so a batch costs what its dates hold and not all of history.
    """
    spark = requests.sparkSession
    out, ckpt = stream_paths(spark, "bookings", source)
    hist = sessions.select("coach_id", "member_id", "session_date", "session_time", "status")

    def validate(batch: DataFrame, bid: int) -> DataFrame:
        lo, hi = batch.agg(F.min("session_date"), F.max("session_date")).first()
        dates = F.col("session_date").between(F.lit(lo), F.lit(hi)) | F.col("session_date").isNull()
        # only earlier batches count, so a replayed batch sees the same history
        prev = read_sink(spark, out, BOOKING_SCHEMA).filter(dates & (F.col("_batch") < bid))
        busy = (hist.filter(dates).unionByName(
            prev.filter("accepted").select("coach_id", "member_id", "session_date", "session_time",
                                           F.lit("Scheduled").alias("status"))))
        # a redelivered request has the same date, so it is found among these
        new = (batch.dropDuplicates(["request_id"])
               .join(prev.select("request_id").distinct(), "request_id", "left_anti"))
        return validate_bookings(new, members, coaches, member_coach, busy)

    _run(requests, out, ckpt, validate, by="session_date").awaitTermination()
    return read_sink(spark, out, BOOKING_SCHEMA).drop("_batch")
