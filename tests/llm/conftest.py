import random

import pytest

# Rows with nulls in any column, empty and long texts, ties, repeated rows and odd characters.
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def edge_rows():
    rnd = random.Random(4)
    base = [f"word{rnd.randrange(3000)}" for _ in range(150)]
    near = base[:70] + ["changed"] + base[71:]
    return [
        (None, None, None, None), (None, " a b c d e f g ", "en", "s1"), (1, "", "en", None), (2, " \t\n\x0b\x0c\r ", None, "s1"),
        (3, LONG, "en", "s1"), (4, "tie tie", "en", "s1"), (4, "tie tie", "en", "s1"), (5, "tie  tie", "en", "s2"),
        (6, "tietie", "de", "s2"), (7, " ".join(base), "en", "s1"), (8, " ".join(base).upper(), "en", "s1"),
        (9, " ".join(near), "en", "s3"), (10, " ".join(base[:60]) + " " + PASSAGE, "en", "s1"),
        (11, "x " + PASSAGE + " y", "fr", "s1"), (12, PASSAGE + PASSAGE, "fr", "s1"),
        (13, "aaaa" * 300, None, "s1"), (14, "\x01\x1c\x85 café CAFÉ 漢字 \U0001f600 <|endoftext|> it's 1½", "en", "s2"),
        (15, "!!! ??? ...", "en", "s2"), (16, "*** ---", "en", "s2"), (17, "all rights reserved. CC BY cc-by, General Public License", "en", "s1"),
        (18, "Released under the MIT License.", "en", "s1"), (19, "one", "en", "s1"), (20, "ONE!", "en", "s1"),
        (2**62, "big id", "en", "s9"), (-5, "negative id", "en", "s9"),
    ]


# Extra columns with the names that the operators use themselves.
EXTRA = ["tag", "digest", "batch", "label", "n", "rank", "row", "position", "block", "score", "key", "rep", "kept", "anchor", "file", "phase"]


def write_docs(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    data = [(d, t, g, s, None if t is None else len(t), *["clash"] * len(EXTRA)) for d, t, g, s in rows]
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    return write_docs(spark, tmp_path_factory.mktemp("edge") / "documents.parquet", edge_rows())


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return write_docs(spark, tmp_path_factory.mktemp("none") / "documents.parquet", [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
