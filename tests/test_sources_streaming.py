"""Sinks, sources and streaming sinks (write then read back; replay)."""

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from gymlake.sources.samples import sample_nutrition
from gymlake.sources.sinks import append, write_report
from gymlake.streaming import streams as st


def test_empty_report_keeps_columns(spark):
    df = spark.createDataFrame([], "member_name string, total_sessions bigint")
    path = tempfile.mkdtemp(dir="/tmp") + "/r"
    write_report(df, path, "csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["member_name", "total_sessions"] and back.count() == 0


def test_append_is_partitioned(spark):
    df = sample_nutrition(spark).withColumn("log_date", F.lit(dt.date(2024, 1, 1)))
    path = tempfile.mkdtemp(dir="/tmp") + "/a"
    append(df, path)
    append(df, path)
    assert os.path.isdir(path + "/log_date=2024-01-01")
    assert spark.read.parquet(path).count() == 14


def test_sample_day_total(spark):
    r = sample_nutrition(spark).agg(F.sum("calories"), F.sum("protein")).first()
    assert (r[0], r[1]) == (1350.0, 129.0)


def test_replayed_micro_batch_is_written_once(spark):
    from gymlake.session import checkpoint_dir
    out = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex[:8]}"
    b0 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b1 = spark.createDataFrame([(3, "c")], "k int, v string")
    st.write_batch(b0, out, 0)
    st.write_batch(b1, out, 1)
    st.write_batch(b0, out, 0)          # batch 0 replayed after a failure
    rows = sorted((r["k"], r["_batch"]) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 0), (2, 0), (3, 1)]
