import os
from collections import Counter

import pytest

import corpus_pipeline as cp
import __spark_entry__ as se
from test_operators_llm import brute_exact, brute_links, check_packing, plain

SF = "/root/testdata/sf0.001"
KEPT = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and reread as in run()."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in out}


def whole(df):
    return Counter(tuple(r[c] for c in KEPT) for r in df.select(*KEPT).collect())


def test_order_of_the_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dup", "mix", "pack"]
    assert cp.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "near_dup", "mix"])
def test_stages_return_rows_of_documents(stages, name):
    before, after = stages[name]
    assert tuple(after.columns) == KEPT and not whole(after) - whole(before)


def test_quality_drops_the_rejected_rows(spark, stages):
    from gymlake.llm import quality
    before, after = stages["quality"]
    judged = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert Counter(d for d, *_ in whole(after).elements()) == Counter(r["doc_id"] for r in judged.collect() if r["predicted"])


def test_exact_dedup_keeps_the_best_of_each_group(stages):
    before, after = stages["exact_dedup"]
    want = {k[0] for k in brute_exact(plain(before)) if k[3]}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(want)


def test_near_dup_keeps_one_of_each_class(stages):
    before, after = stages["near_dup"]
    links, groups = brute_links(plain(before))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({k[1] for k in links}) and after.count() == groups


def test_mix_keeps_all_rows(stages):
    before, after = stages["mix"]
    assert whole(before) == whole(after)


def test_packed_sequences_follow_the_mix(stages):
    before, after = stages["pack"]
    check_packing(after.collect(), plain(before), 4096)


def test_run_equals_the_stages(spark, stages):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = Counter(tuple(r[c] for c in key) for r in se.queries()["pipeline"](spark, SF).collect())
    assert got == Counter(tuple(r[c] for c in key) for r in stages["pack"][1].collect())


@pytest.mark.parametrize("table", ["edges", "nothing"])
def test_stages_take_odd_tables(spark, tmp_path, request, table):
    docs = request.getfixturevalue(table)
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([(7, 1, 0), (4, 0, 1), (10, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "sf" / "labels.parquet"))
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert tuple(docs.columns) == KEPT
    if table == "nothing":
        assert docs.count() == 0
