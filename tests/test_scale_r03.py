"""Steps that must not grow faster than their tables: counts by spans, grams by length of the terms."""

import random

from gymlake.operators import scheduling as sc
from gymlake.operators import substrings as ss
from gymlake.operators import upserts as up
from gymlake.sources.keyed import fresh_path


def executed(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


# ---------------------------------------------------------------- F1
def test_availability_counts_repeated_rows_and_broadcasts_no_members(spark):
    links = [(3, 1), (3, 1), (3, 2), (4, 2), (4, None), (None, 1)]
    week = [(1, "member", "Monday", True, "09:00", "11:00"), (1, "member", "Monday", True, "10:00", "12:00"),
            (2, "member", "Monday", True, None, "10:00"), (2, "member", "Someday", True, "08:00", "20:00"),
            (2, "member", "Tuesday", True, "12:00", "09:00"), (2, "coach", "Monday", True, "08:00", "20:00"),
            (2, "member", "Wednesday", False, "08:00", "20:00"), (None, "member", "Monday", True, "08:00", "20:00")]
    slots = [(1, "member", "2024-01-22", 10, False), (2, "member", "2024-01-22", 20, True), (2, "member", "2024-01-22", 9, True),
             (2, "coach", "2024-01-22", 12, True), (9, "member", "2024-01-22", 12, True), (1, "member", "2024-01-22", 13, None)]
    out = sc.group_availability(
        spark.createDataFrame(links, "coach_id int, member_id int"),
        spark.createDataFrame(slots, "user_id int, user_type string, d string, hour int, is_available boolean").selectExpr(
            "user_id", "user_type", "to_date(d) AS slot_date", "hour", "is_available"),
        spark.createDataFrame(week, "user_id int, user_type string, day_of_week string, is_available boolean, start_time string, end_time string"),
        "2024-01-22", "2024-01-23")
    got = {(r.coach_id, r.date.isoformat(), r.hour): r.available_count for r in out.collect() if r.available_count}
    day = "2024-01-22"
    # member 1 is linked to coach 3 twice, and two of its rows open 10:00, of which the override takes one each
    assert got == {(3, day, 8): 1, (3, day, 9): 3, (3, day, 10): 2, (3, day, 11): 2, (3, day, 20): 1,
                   (4, day, 8): 1, (4, day, 9): 1, (4, day, 20): 1}
    joins = [line for line in executed(out).splitlines() if "BroadcastHashJoin" in line and "user_id" in line]
    assert not joins


# ---------------------------------------------------------------- F3, F4
def test_terms_are_looked_up_whole_and_find_no_more_than_their_matches(spark):
    rows = spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(4000)], "id int, name string")
    terms = spark.createDataFrame([(f"{i:06d}",) for i in range(0, 4000, 7)] + [("r#%0012",), ("%",), ("customer#000000123",)], "term string")
    sizes = ss.gram_sizes(terms, "term")
    assert sorted(sizes) == [0, 4, 6, 8]
    index = ss.gram_index(rows, "id", ["name"], sizes)
    asked = {r.term: r.gram for r in ss.probes(terms, "term", index, sizes=sizes).collect()}
    assert asked["000700"] == "000700" and asked["r#%0012"] == "0012" and asked["%"] == ""
    assert asked["customer#000000123"] in {"00000012", "00000123"}  # the rarest of its grams of 8 characters
    out = ss.search_terms(terms, rows, "id", ["name"])
    assert "NestedLoop" not in executed(out)
    got = {}
    for r in out.collect():
        got.setdefault(r.term, set()).add(r.id)
    names = {i: f"customer#{i:09d}" for i in range(4000)}
    assert got["000700"] == {i for i, n in names.items() if "000700" in n}
    assert got["r#%0012"] == {i for i, n in names.items() if "0012" in n[8:]} and got["%"] == {*names} and got["customer#000000123"] == {123}


def test_a_large_bucket_is_written_by_several_tasks(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([("hot", "%030x" % rnd.getrandbits(120)) for _ in range(20_000)], "gram string, id string")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        path = fresh_path(spark, "hot")
        # the rows come from several map tasks, as AQE splits between their outputs
        table = ss.store_index(rows.repartition(8), path, 4)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert len(spark.read.parquet(path).where("NOT _marker").selectExpr("_metadata.file_path AS f").distinct().collect()) > 1
    assert table.read().count() == 20_000


# ---------------------------------------------------------------- F5
def test_writes_are_dealt_before_they_are_sorted(spark):
    base = spark.createDataFrame([(1, "a", "x", 0), (2, "b", None, 0), (None, "n", "y", 0)], "k int, t string, v string, seq long")
    new = spark.createDataFrame([(1, "a", "late", 9), (1, "a", "early", 3), (3, "c", "new", 1)], "k int, t string, v string, seq long")
    out = up.upsert(base, new, ["k", "t"], "seq", keep_first=())
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a", "late", 9), (2, "b", None, 0), (None, "n", "y", 0), (3, "c", "new", 1)], key=str)
    lines = executed(out).splitlines()  # the deepest sort reads a shuffle by key and order
    first = max(i for i, line in enumerate(lines) if "SortAggregate" in line)
    assert any("Exchange hashpartitioning(k" in line and "seq" in line for line in lines[first:])


# ---------------------------------------------------------------- F6
def test_food_documents_are_built_by_all_tasks(tables):
    lines = executed(tables.drifted_food_docs.select("doc_id", "search_json"))
    assert "Exchange hashpartitioning(p_partkey" in lines
