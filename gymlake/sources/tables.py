"""Table scans.  Raw driver tables and the domain tables derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gymlake.sources import fixtures


# Parquet schemas inferred once per session and path; later scans pass the schema
# explicitly, so planning a query does not re-read footers for every table.
_SCHEMAS: dict[tuple[str, str], object] = {}


def load_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """Scan one Parquet table.  Column pruning and filters reach the scan via Catalyst."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if schema is None:
        schema = _SCHEMAS.get(key)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


def stream_table(spark: SparkSession, root: str, name: str, max_files: int | None = 1) -> DataFrame:
    """One Parquet table as a file stream: a folder of part files (new ones may arrive),
    or a single file."""
    table = load_table(spark, root, name)
    path = f"{root.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):
        # a single file is streamed from the folder that holds it
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return reader.parquet(path)


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, **options) -> DataFrame:
    """S1 for a live MySQL source: a range-partitioned parallel JDBC read."""
    return (spark.read.format("jdbc")
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", num_partitions)
            .options(**options).load())


def _sql_with_frames(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Run ``sql`` with ``{name}`` placeholders bound to DataFrames.

    The frames are exposed as temporary views only for the duration of the
    (eager) analysis; the resulting plan inlines them.
    """
    names = {}
    for key, df in frames.items():
        view = f"_gl_{key}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        names[key] = view
    try:
        text = fixtures._PLACEHOLDER.sub(lambda m: names[m.group(1)], sql)
        return spark.sql(text)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


# Tables whose rows become far larger ones in a derivation: (derived, source) -> column by which the
# source is dealt over all tasks first, as a scan of one row group is one task.
DEALT = {("food_docs", "part"): "p_partkey"}


class Tables:
    """Lazy accessor for raw and domain tables of one data directory.

    ``Tables(spark, root).sessions`` is a DataFrame; nothing is computed until an
    action runs.  Domain tables are built once per accessor so a report that
    reads ``sessions`` twice shares one logical subtree (and one exchange reuse).
    """

    def __init__(self, spark: SparkSession, root: str, streamed=(),
                 max_files_per_trigger: int | None = 1):
        self.spark = spark
        self.root = root
        self.streamed = set(streamed)
        self.max_files = max_files_per_trigger
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in self.streamed:
                # a raw table read as a file stream: every derivation over it streams too
                self._cache[name] = stream_table(self.spark, self.root, name, self.max_files)
            elif name in fixtures.RAW_TABLES:
                self._cache[name] = load_table(self.spark, self.root, name)
            elif name in fixtures.FIXTURE_SQL:
                frames = {d: self._source(name, d) for d in fixtures.deps(name)}
                self._cache[name] = _sql_with_frames(
                    self.spark, fixtures.render(name, "spark"), frames)
            else:
                raise KeyError(f"unknown table {name!r}")
        return self._cache[name]

    def _source(self, name: str, source: str) -> DataFrame:
        rows = self.get(source)
        by = DEALT.get((name, source))
        return rows if by is None or rows.isStreaming else rows.repartition(by)
