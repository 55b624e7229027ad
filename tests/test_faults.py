"""Literal-row and brute-force tests of rules that the oracles share with the operators."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from gymlake.operators import bookings as bk
from gymlake.operators import foods, meal_plans, nutrition, ordering, scheduling, upserts
from gymlake.sources.sinks import read_report, write_report
from gymlake.sources.tables import Tables, stream_table
from gymlake.streaming import streams as st

DAY = dt.date(2024, 1, 1)


# ---- X7 ---------------------------------------------------------------------------------

def book_one_by_one(requests):
    taken, accepted = set(), set()
    for rid, coach, member, slot in requests:
        if ("c", coach, slot) not in taken and ("m", member, slot) not in taken:
            taken |= {("c", coach, slot), ("m", member, slot)}
            accepted.add(rid)
    return accepted


def accepted_ids(spark, requests):
    df = spark.createDataFrame([(r, c, m, DAY, f"{s:02d}:00") for r, c, m, s in requests],
                               "request_id long, coach_id int, member_id int, session_date date, session_time string")
    return {r["request_id"] for r in bk.accept_in_order(df).collect()}


def test_a_loser_blocks_nobody(spark):
    assert accepted_ids(spark, [(1, 1, 1, 9), (2, 2, 1, 9), (3, 2, 2, 9)]) == {1, 3}


def test_booking_equals_one_by_one_on_chains(spark):
    rnd = random.Random(8)
    chain = [(i, (i + 1) // 2, i // 2, 9) for i in range(12)]
    crowd = [(100 + i, rnd.randrange(6), rnd.randrange(6), rnd.randrange(3) + 10) for i in range(80)]
    requests = chain + crowd
    got = accepted_ids(spark, rnd.sample(requests, len(requests)))
    assert got == book_one_by_one(requests)
    # no accepted pair shares a cell, and no refused request has both cells free
    cells = [x for r, c, m, s in requests if r in got for x in (("c", c, s), ("m", m, s))]
    assert len(cells) == len(set(cells))
    assert all(("c", c, s) in cells or ("m", m, s) in cells for r, c, m, s in requests)


# ---- J19, X19, X11, X16, X18, O4 -----------------------------------------------------------

def test_a_plan_is_chosen_whole(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    plans = spark.createDataFrame(
        [(10, 1, dt.datetime(2024, 1, 1), "Old", 1800, None, 200, 60), (11, 1, dt.datetime(2024, 2, 1), "New", 2100, 222, 210, 70),
         (12, 2, dt.datetime(2024, 2, 1), None, 1500, 99, None, 50)],
        "id long, member_id int, created_at timestamp_ntz, plan_name string, daily_calories int, daily_protein int, daily_carbs int, daily_fat int")
    picked = spark.createDataFrame([(1, 10)], "member_id int, selected_plan_id long")
    got = {r["member_id"]: r for r in meal_plans.effective_plan(members, plans, picked).collect()}
    assert (got[1]["plan_id"], got[1]["daily_protein"], got[1]["plan_name"], got[1]["source"]) == (10, 150, "Old", "selected")
    assert (got[2]["plan_id"], got[2]["plan_name"], got[2]["daily_carbs"], got[2]["source"]) == (12, "Default Plan", 250, "latest")
    assert (got[3]["plan_id"], got[3]["daily_calories"], got[3]["source"]) == (None, 2000, "default")


def test_patches_of_one_key_make_one_row(spark):
    base = spark.createDataFrame([(1, "Scheduled", "a"), (2, "Scheduled", "b")], "id int, status string, notes string")
    patches = spark.createDataFrame([(1, "Completed", None, 1), (1, "bad", "new", 2), (1, None, None, 3)],
                                    "id int, status string, notes string, seq int")
    got = sorted(tuple(r) for r in upserts.update_rows(base, patches, "id", {"status": ("Scheduled", "Completed")}, "seq").collect())
    assert got == [(1, "Completed", "new"), (2, "Scheduled", "b")]


def test_inverted_and_odd_ranges_write_no_slot(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, d(2), d(3), 8, 9), (2, d(3), d(2), 10, 8), (3, d(2), d(2), 10, 8), (4, d(2), d(2), 22, 25), (5, None, d(2), 1, 2)]
    req = spark.createDataFrame([(i, i, "member", a, b, c, e, True, i) for i, a, b, c, e in rows],
                                "request_id int, user_id int, user_type string, start_date date, end_date date, start_hour int, "
                                "end_hour int, is_available boolean, seq int")
    got = sorted((r["user_id"], r["slot_date"].day, r["hour"]) for r in scheduling.bulk_requests_to_slots(req).collect())
    assert got == [(1, 2, 8), (1, 2, 9), (1, 3, 8), (1, 3, 9)]
    reasons = {r["request_id"]: r["reason"] for r in scheduling.rejected_bulk_requests(req).collect()}
    texts = scheduling.RANGE_REASONS
    assert reasons == {2: texts["inverted"], 3: texts["inverted"], 4: texts["hours"], 5: texts["missing"]}


def test_text_among_nutriments_and_the_search_shape(spark):
    docs = [("1", '{"status": 1, "product": {"product_name": "A", "nutriments": {"energy-kcal_100g": 12, "energy_unit": "kcal", "fat_100g": "3.5"}}}'),
            ("2", '{"products": [{"product_name": "B", "code": "77", "nutriments": {"proteins_100g": 4}}, {"brands": "C"}]}'),
            ("3", '{"status": 0, "product": {"product_name": "gone"}}')]
    df = spark.createDataFrame(docs, "barcode string, product_json string")
    got = [(r["name"], r["calories_per_100g"], r["protein_per_100g"], r["fat_per_100g"], r["product_barcode"])
           for r in foods.flatten_products(df).orderBy("barcode", "name").collect()]
    assert got == [("A", 12.0, 0.0, 3.5, "1"), ("B", 0.0, 4.0, 0.0, "77"), ("Unknown", 0.0, 0.0, 0.0, "")]


def test_a_stated_zero_stays_zero(spark):
    e = spark.createDataFrame([(1, "lunch", "grams", 10.0, 0.0, 20.0, 30.0, 5.0, DAY)],
                              "member_id int, meal_type string, unit string, quantity double, total_calories double, "
                              "total_protein double, total_carbs double, total_fat double, log_date date")
    assert float(nutrition.log_day_totals(e).first()["total_calories"]) == 0.0


def test_a_page_limit_out_of_range_is_an_error(spark):
    df = spark.range(3).withColumn("k", F.lit(1))
    for page, limit in ((1, 1001), (1, 0), (0, 10)):
        with pytest.raises(ValueError):
            ordering.paginate(df, "k", [F.col("id")], page, limit)
    assert ordering.paginate(df, "k", [F.col("id")], 1, 1000).count() == 3


# ---- S6 -----------------------------------------------------------------------------------

def test_report_round_trip_of_odd_text(spark, tmp_path):
    rows = [(1, 'say "hi"', "a\nb,c"), (2, "", None), (3, None, "x\r\ny"), (4, "back\\slash", '"')]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    write_report(df, str(tmp_path / "r"))
    got = sorted((tuple(r) for r in read_report(spark, str(tmp_path / "r"), df.schema).collect()))
    want = [(1, 'say "hi"', "a\nb,c"), (2, "", None), (3, None, "x\ny"), (4, "back\\slash", '"')]
    same = lambda x: (x or "").replace("\r\n", "\n")  # noqa: E731  an empty text comes back as missing
    assert [(i, same(a), same(b)) for i, a, b in got] == [(i, same(a), same(b)) for i, a, b in want]


def test_an_empty_report_keeps_columns_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "gym_id int, name string")
    write_report(df.limit(0), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["gym_id", "name"]
    write_report(df, str(tmp_path / "p"), "csv", "gym_id")
    assert os.path.isdir(tmp_path / "p" / "gym_id=1")


# ---- T1, T2, T3 -----------------------------------------------------------------------------

def in_parts(spark, root, name, order_by, n, tmp_path):
    """The table cut at random into n files, and the paths of these files in random order."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    parts = []
    for k, part in enumerate(df.randomSplit([1.0] * n, seed=5)):
        part.coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        d = tmp_path / f"{name}-{k}"
        parts.append(next(str(d / f) for f in sorted(os.listdir(d)) if f.endswith(".parquet")))
    return random.Random(3).sample(parts, n)


def arrive(files, folder, start):
    os.makedirs(folder, exist_ok=True)
    for k, f in enumerate(files, start):
        target = f"{folder}/part-{k}.parquet"
        shutil.copy(f, target)
        os.utime(target, (1_700_000_000 + 100 * k,) * 2)  # arrival order


@pytest.fixture()
def lake(spark, tmp_path):
    """sf0.001 with tables as folders; the streamed ones fill up in two goes."""
    root = tmp_path / "lake"
    os.makedirs(root)
    for f in os.listdir("/root/testdata/sf0.001"):
        name = f.removesuffix(".parquet")
        if name in ("lineitem", "events", "orders"):
            continue
        arrive([f"/root/testdata/sf0.001/{f}"], str(root / f), 0)
    files = {n: in_parts(spark, "/root/testdata/sf0.001", n, None, 5, tmp_path) for n in ("lineitem", "events", "orders")}
    return str(root), files


def both_goes(lake, name, run):
    root, files = lake
    arrive(files[name][:3], f"{root}/{name}.parquet", 0)
    for other in files:
        if other != name:
            arrive(files[other], f"{root}/{other}.parquet", 0)
    first = run()
    arrive(files[name][3:], f"{root}/{name}.parquet", 3)  # the job stopped; more comes; it starts again
    return first, run()


def test_daily_nutrition_stream_drops_nothing(spark, lake):
    root = lake[0]
    first, last = both_goes(lake, "lineitem", lambda: st.run_daily_nutrition(
        Tables(spark, root, streamed=["lineitem"]).nutrition_logs, root).collect())
    batch = nutrition.daily_nutrition(Tables(spark, "/root/testdata/sf0.001").nutrition_logs)
    key = lambda r: (r["member_id"], r["log_date"], r["calories"], r["protein"], r["entries_count"])
    assert sorted(map(key, last)) == sorted(map(key, batch.collect()))
    assert 0 < sum(r["entries_count"] for r in first) < sum(r["entries_count"] for r in last)


def test_availability_stream_resumes(spark, lake):
    root = lake[0]
    _, last = both_goes(lake, "events", lambda: st.run_availability(
        Tables(spark, root, streamed=["events"]).slot_updates, root).collect())
    want = Tables(spark, "/root/testdata/sf0.001").availability_slots.select(*st.SLOT_KEY, "is_available", "seq")
    assert sorted(map(tuple, last)) == sorted(map(tuple, want.collect()))


def test_booking_stream_books_in_arrival_order(spark, lake):
    root, files = lake
    t = Tables(spark, "/root/testdata/sf0.001")

    def run():
        s = Tables(spark, root, streamed=["orders"])
        return st.run_bookings(s.order_booking_requests, t.members, t.coaches, t.member_coach, t.sessions, root).collect()
    # the last file brings requests that were there before
    first, last = both_goes((root, files | {"orders": files["orders"] + files["orders"][:1]}), "orders", run)
    assert len(last) == t.order_booking_requests.count() == len({r["request_id"] for r in last})
    kept = {r["request_id"]: r["accepted"] for r in last}
    assert all(kept[r["request_id"]] == r["accepted"] for r in first)
    # one by one, file after file, among those that pass the other checks
    checks = (bk.REASONS["missing"], bk.REASONS["tenancy"], bk.REASONS["assignment"])
    history = {(k, r[f], r["session_date"], r["session_time"]) for r in t.sessions.filter(F.lower("status") != "cancelled").collect()
               for k, f in (("c", "coach_id"), ("m", "member_id"))}
    by_id = {r["request_id"]: r for r in last}
    want, seen = set(), set()
    for f in files["orders"]:
        for rid in sorted(r["o_orderkey"] for r in spark.read.parquet(f).select("o_orderkey").collect()):
            r = by_id[rid]
            cells = {("c", r["coach_id"], r["session_date"], r["session_time"]), ("m", r["member_id"], r["session_date"], r["session_time"])}
            if rid not in seen and r["reason"] not in checks and not cells & history:
                history |= cells
                want.add(rid)
            seen.add(rid)
    assert {r["request_id"] for r in last if r["accepted"]} == want and want


def test_a_single_file_streams_alone(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(3 if n == "a" else 5).coalesce(1).write.parquet(str(tmp_path / f"{n}-dir"))
        f = next(x for x in os.listdir(tmp_path / f"{n}-dir") if x.endswith(".parquet"))
        shutil.copy(tmp_path / f"{n}-dir" / f, tmp_path / f"{n}.parquet")
    got = []
    q = stream_table(spark, str(tmp_path), "a").writeStream.foreachBatch(lambda b, _i: got.extend(b.collect())).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) == 3


def test_a_broken_sink_is_not_an_empty_one(spark, tmp_path):
    assert st.read_sink(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        st.read_sink(spark, str(tmp_path / "bad"), "a int").count()
