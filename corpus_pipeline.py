"""Training-data pipeline over ``documents``: five stages, each written as Parquet and
reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents`` (other columns are not read).  ``docs`` is a scan of written files:
stages number its rows by file and place, and the packing stage follows the order of the mixed
files.  Repeated rows are documents of their own until a stage drops them, a null doc_id is
kept, very long texts are read whole, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import load, numbered, sized, scratch_path, stored
from gymlake.llm.exact_dedup import dedup_rows
from gymlake.llm.mixing import in_mix_order
from gymlake.llm.near_dup import near_rows
from gymlake.llm.packing import pack
from gymlake.llm.quality import keep_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Shares of the sources in the mix; the others have 1.
SHARES = {"src0": 6, "src1": 3, "src2": 2}


def _without_dropped(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The numbered ``rows`` that ``judged`` (by the same numbers) keeps, as documents."""
    dropped = stored(judged.where("NOT kept").select("tag"), "dropped")
    return rows.join(sized(dropped, dropped.count()), "tag", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts have the
    score of a text without words.  Without labels of both classes none is rejected for its text."""
    return keep_quality(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (null counts as empty; of rows that tie in
    length and doc_id one stays)."""
    rows = numbered(docs, *COLUMNS)
    return _without_dropped(rows, dedup_rows(rows))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; texts without words, null ones too, are
    in no class and stay."""
    rows = numbered(docs, *COLUMNS)
    return _without_dropped(rows, near_rows(rows))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix; a null source is a source."""
    return in_mix_order(docs.select(*COLUMNS), SHARES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, batch by batch in mix order; a null
    or empty text is one piece with its end id."""
    return pack(docs, in_file_order=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dup", near), ("mix", mixed), ("pack", packed)]

# The stages train a classifier, schedule and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
