"""Schema probe and constraint checks, as DataFrames (nothing collected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.sources.schemas import ENUMS, RANGES, SCHEMAS, UNIQUE_KEYS


def describe_table(df: DataFrame, table: str) -> DataFrame:
    """One row per expected column: present?, actual type, expected type, and
    the table's row count (a single aggregate over the scan)."""
    expected = SCHEMAS.get(table)
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [f.name for f in expected.fields] if expected else list(actual)
    rows = [(table, n, n in actual, actual.get(n),
             expected[n].dataType.simpleString() if expected and n in expected.fieldNames() else None)
            for n in names]
    fields = ("table_name", "column_name", "present", "actual_type", "expected_type")
    meta = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f) for v, f, t in
                                zip(r, fields, ("string", "string", "boolean", "string", "string"))])
                     for r in rows])
    # the metadata rows are generated from the one-row aggregate itself: no join
    return (df.agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.inline(meta), "row_count"))


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """S3: violations of enum domains (case-insensitive), ranges and unique keys,
    as (table, check, column, bad_rows).

    All enum and range checks are counted in one aggregate pass over the table and
    unpivoted into rows; only the unique-key check needs its own grouping."""
    checks = []  # (check name, column, bad-row condition)
    for (t, col), values in ENUMS.items():
        if t == table and col in df.columns:
            checks.append(("enum", col, ~F.lower(F.col(col)).isin([v.lower() for v in values])
                           & F.col(col).isNotNull()))
    for (t, col), (lo, hi) in RANGES.items():
        if t == table and col in df.columns:
            checks.append(("range", col, ~F.col(col).between(lo, hi)))
    parts = []
    if checks:
        counts = df.agg(*[F.count(F.when(bad, 1)).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
        rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(col).alias("column_name"),
                                  F.col(f"c{i}").alias("bad_rows"))
                         for i, (name, col, _) in enumerate(checks)])
        parts.append(counts.select(F.inline(rows))
                     .select(F.lit(table).alias("table_name"), "check_name", "column_name", "bad_rows"))
    key = UNIQUE_KEYS.get(table)
    if key and all(k in df.columns for k in key):
        dup = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
               .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad_rows")))
        parts.append(dup.select(F.lit(table).alias("table_name"), F.lit("unique").alias("check_name"),
                                F.lit(",".join(key)).alias("column_name"), "bad_rows"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "table_name string, check_name string, column_name string, bad_rows bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)
