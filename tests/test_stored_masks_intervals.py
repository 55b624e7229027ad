"""Hour masks, keyed writes on stored tables, interval overlap, and rules of bookings and imports,
against brute force and literal rows."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from gymlake.operators import bookings as bk
from gymlake.operators import hour_masks as hm
from gymlake.operators import intervals as iv
from gymlake.operators import meal_plans as mp
from gymlake.operators import scheduling as sc
from gymlake.operators import upserts as up
from gymlake.sources.keyed import KeyedTable, fresh_path

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONDAY = dt.date(2024, 1, 22)


# ---- hour masks ---------------------------------------------------------------------------

@pytest.mark.parametrize("start, end, hours", [
    (8, 12, [8, 9, 10, 11]), (0, 24, list(range(24))), (20, 30, [20, 21, 22, 23]), (-3, 2, [0, 1]), (9, 9, []), (12, 8, []),
    (None, 5, []), (5, None, []), (23, 24, [23])])
def test_range_masks(spark, start, end, hours):
    df = spark.createDataFrame([(start, end)], "a int, b int").select(hm.hours_of(hm.range_mask(F.col("a"), F.col("b"))).alias("h"))
    assert df.first()["h"] == hours


def test_preferred_hours_outside_the_day_are_no_bits(spark):
    df = spark.createDataFrame([([9, 24, -1, 9, 0],), (None,), ([],)], "h array<int>").select(hm.array_mask(F.col("h")).alias("m"))
    assert [r["m"] for r in df.collect()] == [1 | 1 << 9, 0, 0]


def random_week(rnd, kind, users):
    rows = []
    for u in users:
        for d in DAYS:
            for _ in range(rnd.choice([0, 1, 1, 2])):  # a day may be stored twice
                a = rnd.randrange(0, 24)
                rows.append((u, kind, d, rnd.random() < 0.8, f"{a:02d}:00", f"{rnd.randrange(0, 26):02d}:00"))
    return rows + [(users[0], kind, "Someday", True, "08:00", "20:00"), (users[0], kind, None, True, "08:00", "20:00")]


def open_hours(rows, user, day):
    return {h for u, _, d, av, a, b in rows if u == user and d == DAYS[day] and av for h in range(int(a[:2]), min(24, int(b[:2])))}


@pytest.mark.parametrize("now", ["2024-01-25 10:30:00", "2024-01-25 10:00:00", "2024-01-28 23:59:00", "2024-01-22 00:00:00"])
def test_matched_slots_equal_brute_force(spark, now):
    rnd = random.Random(now)
    coaches, members = [1, 2], [11, 12, 13]
    free = random_week(rnd, "coach", coaches) + random_week(rnd, "member", members)
    prefs = [(u, k, rnd.choice([None, "[]", '["09:00","10:00"]', '["18:00","25:00"]', "bad"]))
             for k, us in (("coach", coaches), ("member", members)) for u in us]
    at = dt.datetime.fromisoformat(now)
    sessions = [(i, rnd.choice(coaches), rnd.choice(members), at.date() + dt.timedelta(days=rnd.randrange(-1, 9)),
                 f"{rnd.randrange(24):02d}:{rnd.choice([0, 15, 45]):02d}", rnd.choice([0, 30, 90, 600]), rnd.choice(["Scheduled", "Cancelled"]))
                for i in range(25)]
    pairs = [(c, m) for c in coaches for m in members] + [(1, 11), (1, 99)]
    got = sc.match_slots(
        spark.createDataFrame(pairs, "coach_id int, member_id int"),
        spark.createDataFrame(free, "user_id int, user_type string, day_of_week string, is_available boolean, start_time string, end_time string"),
        spark.createDataFrame(prefs, "user_id int, user_type string, preferred_time_slots string"),
        spark.createDataFrame(sessions, "id int, coach_id int, member_id int, session_date date, session_time string, duration int, status string"),
        now, 60, 10).collect()

    def likes(user, kind, hour):
        text = next(t for u, k, t in prefs if (u, k) == (user, kind))
        return bool(text) and text.startswith("[") and f'"{hour:02d}:00"' in text

    want = []
    for c, m in sorted(set(pairs) - {(1, 99)}):
        slots = []
        first = dt.datetime.combine(at.date(), dt.time())
        for n in range(8 * 24):
            t = first + dt.timedelta(hours=n)
            if not at < t <= at + dt.timedelta(days=7):
                continue
            if t.hour not in open_hours(free, c, t.weekday()) & open_hours(free, m, t.weekday()):
                continue
            busy = False
            for _, sc_, sm, d, time, length, status in sessions:
                s = dt.datetime.combine(d, dt.time.fromisoformat(time))
                if status == "Scheduled" and (sc_ == c or sm == m) and d >= at.date():
                    busy |= t < s + dt.timedelta(minutes=length) and t + dt.timedelta(hours=1) > s
            if not busy:
                cl, ml = likes(c, "coach", t.hour), likes(m, "member", t.hour)
                slots.append((-(4 if cl and ml else 3 if cl else 2 if ml else 1), t))
        want += [(c, m, t.strftime("%Y-%m-%d"), DAYS[t.weekday()], t.hour, -s, k + 1) for k, (s, t) in enumerate(sorted(slots)[:10])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_slot_matching_shuffles_no_candidates(spark, tables):
    df = sc.match_slots(tables.member_coach, tables.free_days, tables.user_preferences, tables.sessions, "2024-01-25 10:30:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Join")]  # above the pair join
    assert "Exchange" not in top and "Window" not in plan and "Sort [" not in top


def test_a_date_that_is_opened_and_closed_counts_as_open(spark):
    users = spark.createDataFrame([(1, "member")], "user_id int, user_type string")
    slots = spark.createDataFrame([(1, "member", MONDAY, 9, True), (1, "member", MONDAY, 9, False), (1, "member", MONDAY, 10, False)],
                                  "user_id int, user_type string, slot_date date, hour int, is_available boolean")
    week = spark.createDataFrame([(1, "member", "Monday", True, "09:00", "12:00")],
                                 "user_id int, user_type string, day_of_week string, is_available boolean, start_time string, end_time string")
    got = sc.effective_availability(users, slots, week, "2024-01-22", "2024-01-28").collect()
    assert sorted(r["hour"] for r in got) == [9, 11]


def test_a_slot_stored_twice_does_not_stop_the_calendar(spark):
    users = spark.createDataFrame([(1, "member")], "user_id int, user_type string")
    slots = spark.createDataFrame([(1, "member", MONDAY, 9, True), (1, "member", MONDAY, 9, False)],
                                  "user_id int, user_type string, slot_date date, hour int, is_available boolean")
    got = [r["slots"] for r in sc.month_calendar(users, slots, 2024, 1).collect() if r["slots"]]
    assert got == [{9: True}]


# ---- keyed writes -------------------------------------------------------------------------

ROW = "id long, owner int, amount int, created_at timestamp, seq long"
T0 = dt.datetime(2024, 1, 1)


def stored_table(spark, n=2000, buckets=16):
    rows = spark.createDataFrame([(i, i % 5, i, T0, 0) for i in range(n)], ROW)
    return rows, KeyedTable.create(rows, fresh_path(spark, "keyed-test"), "id", buckets)


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path.removeprefix('file:')}/*/*.parquet")}


def test_an_update_touches_only_its_buckets(spark):
    rows, table = stored_table(spark)
    before = files(table)
    updates = spark.createDataFrame([(7, 1, -1, T0 + dt.timedelta(1), 5), (7, 1, -2, T0 + dt.timedelta(2), 4), (10**9, 9, 9, T0, 1)], ROW)
    want = sorted(tuple(r) for r in up.upsert(rows, updates, "id", ["seq"]).collect())
    touched = table.upsert(updates, ["seq"])
    assert 1 <= len(touched) <= 2
    after = files(table)
    kept = {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept) and len(kept) >= len(before) * 12 / 16
    assert sorted(tuple(r) for r in table.read().collect()) == want
    assert (7, 1, -1, T0, 5) in want  # the last write, the first creation time
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    scanned = table.read(touched).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("_bucket=")[1].split("/")[0]) for r in scanned} == set(touched)
    # run again after a failure: the same table
    table.upsert(updates, ["seq"])
    assert sorted(tuple(r) for r in table.read().collect()) == want


def test_a_bucket_may_lose_its_last_row(spark):
    rows, table = stored_table(spark, 40, 8)
    table.delete(rows.select("id").filter("id >= 3"))
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 2]
    table.delete(rows.select("id"))
    assert table.read().collect() == []
    table.upsert(rows.filter("id = 5"), ["seq"])
    assert [r["id"] for r in table.read().collect()] == [5]


def test_patches_and_guarded_deletes_of_a_stored_table(spark):
    _, table = stored_table(spark, 50, 8)
    table.patch(spark.createDataFrame([(3, 100), (4, None), (999, 5)], "id long, amount int"))
    table.delete(spark.createDataFrame([(10, 0), (11, 4), (12, 2)], "id long, owner int"), owner="owner")
    got = {r["id"]: r["amount"] for r in table.read().collect()}
    assert got[3] == 100 and got[4] == 4 and 999 not in got
    assert 10 not in got and 11 in got and 12 not in got and len(got) == 48


def test_null_keys_and_no_keys(spark):
    rows = spark.createDataFrame([(None, "a", 1), (1, None, 2)], "k int, j string, v int")
    table = KeyedTable.create(rows, fresh_path(spark, "keyed-test"), ["k", "j"], 4)
    assert table.upsert(rows.limit(0), ["v"], ()) == []
    assert sorted(r["v"] for r in table.read().collect()) == [1, 2] and table.read([]).collect() == []


def test_an_upsert_by_one_number_is_a_hash_aggregate(spark):
    base = spark.createDataFrame([(1, "x", True, 3), (2, "x", True, 9), (3, "x", True, None)], "user_id int, user_type string, is_available boolean, seq long")
    new = spark.createDataFrame([(1, "x", False, 1), (1, "x", True, 0), (4, "x", False, None)], base.schema)
    df = up.upsert(base, new, ["user_id", "user_type"], ["seq"], ())
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", False, 1), (2, "x", True, 9), (3, "x", True, None), (4, "x", False, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


# ---- intervals ----------------------------------------------------------------------------

SESSION = "id int, coach_id int, member_id int, session_date date, session_time string, duration int, status string"


def random_sessions(rnd, n, first=0):
    return [(first + i, rnd.randrange(3), rnd.randrange(6), MONDAY + dt.timedelta(days=rnd.randrange(2)),
             f"{rnd.choice([0, 9, 10, 23]):02d}:{rnd.randrange(60):02d}", rnd.choice([0, 0, 1, 20, 45, 60, 200, 1500]),
             rnd.choice(["Scheduled", "Scheduled", "cancelled"])) for i in range(n)]


def minutes(row):
    s = int((dt.datetime.combine(row[3], dt.time.fromisoformat(row[4])) - dt.datetime(1970, 1, 1)).total_seconds()) // 60
    return s, s + max(row[5] or 0, 0)


def meet(a, b):
    (s, e), (x, y) = minutes(a), minutes(b)
    return s < y and e > x


def test_overlap_of_any_minute_equals_brute_force(spark):
    rnd = random.Random(3)
    held, asked = random_sessions(rnd, 40), random_sessions(rnd, 120, 1000)
    got = iv.overlap_check(spark.createDataFrame(asked, SESSION).withColumnRenamed("id", "request_id"),
                           spark.createDataFrame(held, SESSION)).collect()
    active = [h for h in held if h[6] == "Scheduled"]
    want = {a[0]: (any(meet(a, h) for h in active if h[1] == a[1]), any(meet(a, h) for h in active if h[2] == a[2])) for a in asked}
    assert {r["request_id"]: (r["coach_busy"], r["member_busy"]) for r in got} == want
    assert {x for x, _ in want.values()} == {True, False}


def test_a_busy_coach_is_one_row_an_hour(spark):
    held = spark.range(20000).selectExpr("CAST(id AS INT) AS id", "1 AS coach_id", "CAST(id AS INT) AS member_id", "DATE '2024-01-22' AS session_date",
                                         "concat('1', CAST(id % 3 AS STRING), ':', CAST(10 + id % 50 AS STRING)) AS session_time",
                                         "10 AS duration", "'Scheduled' AS status")
    assert iv.busy_minutes(held, "coach_id").count() <= 4


def test_pairs_come_once_whatever_the_bucket(spark):
    rnd = random.Random(5)
    rows = random_sessions(rnd, 60)
    active = [r for r in rows if r[6] == "Scheduled"]
    want = sorted((a[2], a[0], b[0]) for a in active for b in active if a[2] == b[2] and a[0] < b[0] and meet(a, b))
    df = iv.as_intervals(spark.createDataFrame(rows, SESSION).filter("status = 'Scheduled'"), "member_id", "id")
    for bucket in (1, 30, 240, 100000):
        got = iv.overlap_pairs(df, df, "member_id", bucket).filter("left_id < right_id").collect()
        assert sorted((r["member_id"], r["left_id"], r["right_id"]) for r in got) == want
    assert sorted(tuple(r) for r in iv.double_bookings(spark.createDataFrame(rows, SESSION), "member_id").collect()) == want and want


def test_peak_load_equals_counting_minutes(spark):
    rows = random_sessions(random.Random(9), 50)
    got = {(r["coach_id"], r["date"]): (r["peak"], r["at_minute"]) for r in iv.peak_load(spark.createDataFrame(rows, SESSION), "coach_id").collect()}
    load = {}
    for r in rows:
        if r[6] == "Scheduled":
            for m in range(*minutes(r)):
                day = dt.date(1970, 1, 1) + dt.timedelta(days=m // 1440)
                load.setdefault((r[1], day), {}).setdefault(m % 1440, 0)
                load[(r[1], day)][m % 1440] += 1
    assert got == {k: (max(v.values()), min(m for m in v if v[m] == max(v.values()))) for k, v in load.items()}


def test_sessions_without_a_time_or_length(spark):
    rows = [(1, 1, 1, MONDAY, None, 30, "Scheduled"), (2, 1, 1, None, "09:00", 30, "Scheduled"), (3, 1, 1, MONDAY, "09:00", None, "Scheduled"),
            (4, 1, 1, MONDAY, "08:30", 60, "Scheduled"), (5, 1, 1, MONDAY, "08:30", -60, "Scheduled")]
    df = spark.createDataFrame(rows, SESSION)
    assert [tuple(r) for r in iv.double_bookings(df, "coach_id").collect()] == [(1, 3, 4)]
    flags = iv.overlap_check(df.withColumnRenamed("id", "request_id"), df.limit(0)).collect()
    assert len(flags) == 5 and not any(r["coach_busy"] or r["member_busy"] for r in flags)


# ---- bookings, imports, plans -------------------------------------------------------------

def test_a_request_id_books_once(spark):
    req = [(1, 1, 1, MONDAY, "09:00", 60), (1, 1, 1, MONDAY, "09:00", 60),  # sent twice
           (2, 1, 1, MONDAY, "10:00", 60), (2, 1, 1, MONDAY, "11:00", 60),  # two requests, one id
           (3, 1, 1, MONDAY, "11:00", 60), (None, 1, 1, MONDAY, "12:00", 60), (None, 1, 1, MONDAY, "13:00", 60)]
    requests = spark.createDataFrame(req, "request_id long, coach_id int, member_id int, session_date date, session_time string, duration int")
    people = spark.createDataFrame([(1, 1)], "id int, gym_id int")
    pair = spark.createDataFrame([(1, 1)], "member_id int, coach_id int")
    none = spark.createDataFrame([], SESSION)
    got = bk.validate_bookings(requests, people, people, pair, none).collect()
    assert sorted(((r["request_id"] or 0, r["session_time"], r["reason"]) for r in got), key=str) == sorted([
        (0, "12:00", bk.REASONS["missing"]), (0, "13:00", bk.REASONS["missing"]), (1, "09:00", None), (2, "10:00", None),
        (2, "11:00", bk.REASONS["repeated"]), (3, "11:00", None)], key=str)


def test_coach_emails_are_one_whatever_their_case(spark):
    imports = spark.createDataFrame([(1, 1, "A", "A@x.test", "Yoga"), (2, 1, "B", "a@X.test", "Yoga"), (3, 1, "C", "taken@x.test", "Yoga")],
                                    "import_id int, gym_id int, name string, email string, specialization string")
    coaches = spark.createDataFrame([("Taken@X.test",)], "email string")
    got = {r["import_id"]: r["reason"] for r in up.validate_coaches(imports, coaches).collect()}
    assert got == {1: None, 2: up.COACH_REASONS["batch"], 3: up.COACH_REASONS["duplicate"]}


def test_a_plan_update_states_every_field_and_comes_from_the_members_coach(spark):
    plans = spark.createDataFrame([(1, 11), (2, 12)], "id long, member_id int")
    pairs = spark.createDataFrame([(11, 5), (11, 5), (12, 6)], "member_id int, coach_id int")
    asked = [(1, 5, "P", 1, 1, 1, 1, 1), (1, 5, "Q", 2, 2, 2, 2, 2), (1, 5, "", 3, 3, 3, 3, 3), (1, 5, "R", 4, 0, 4, 4, 4),
             (1, 5, "S", 5, None, 5, 5, 5), (2, 5, "T", 6, 6, 6, 6, 6)]
    req = spark.createDataFrame(asked, "plan_id long, coach_id int, plan_name string, daily_calories int, daily_protein int, daily_carbs int, daily_fat int, seq long")
    assert [tuple(r) for r in mp.plan_updates(req, plans, pairs).collect()] == [(1, "Q", 2, 2, 2, 2)]


def test_session_rows_have_gym_and_notes(spark):
    booked = spark.createDataFrame([(1, 1, 7, MONDAY, "09:00", 60, "Push", ["Squat", "Plank"], "Warm up"), (2, 2, 7, MONDAY, "10:00", 60, "Core", [], None)],
                                   "request_id int, coach_id int, member_id int, session_date date, session_time string, duration int, "
                                   "workout_type string, exercises array<string>, notes string")
    coaches = spark.createDataFrame([(1, 4), (2, None)], "id int, gym_id int")
    got = bk.session_rows(booked, coaches).collect()
    assert [(r["request_id"], r["gym_id"], r["status"], r["notes"]) for r in got] == [
        (1, 4, "Scheduled", "Workout Type: Push\nExercises:\n1. Squat\n2. Plank\n\nWarm up")]


def test_only_its_sender_deletes_a_message(spark):
    messages = spark.createDataFrame([(1, 5, "coach"), (2, 5, "coach"), (3, 5, "coach")], "id int, sender_id int, sender_type string")
    asked = spark.createDataFrame([(1, 5, "coach"), (2, 6, "coach"), (3, 5, "member")], messages.schema)
    assert sorted(r["id"] for r in up.guarded_delete(messages, asked, "id", ["sender_id", "sender_type"]).collect()) == [2, 3]


# ---- streams with keyed sinks -------------------------------------------------------------

def test_a_streams_sink_grows_with_its_keys_and_not_with_its_batches(spark, tmp_path):
    from gymlake.streaming import streams as st
    schema = "user_id int, user_type string, slot_date date, hour int, is_available boolean, seq long"
    folder = str(tmp_path / "in")
    source = str(tmp_path)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return sorted(tuple(r) for r in st.run_availability(stream, source).collect())

    for n in range(6):
        rows = [(u, "member", MONDAY, 9, (u + n) % 2 == 0, 100 * n + u) for u in range(5)]
        # an older write of a slot that comes late changes nothing
        spark.createDataFrame(rows + [(0, "member", MONDAY, 9, True, -n)], schema).coalesce(1).write.mode("append").parquet(folder)
        if n == 2:
            go()  # stops here and is started again for the rest
    want = [(u, "member", MONDAY, 9, (u + 5) % 2 == 0, 500 + u) for u in range(5)]
    assert go() == want and go() == want
    out, _ = st.stream_paths(spark, "availability", source)
    assert spark.read.parquet(out).count() == 5 + st.SINK_BUCKETS  # a row per key and a marker per bucket
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != st.ROCKSDB


def test_other_rules_mean_another_table(spark, monkeypatch):
    from gymlake.streaming import streams as st
    old = st.stream_paths(spark, "bookings", "x")
    monkeypatch.setitem(st.RULES, "bookings", 99)
    assert st.stream_paths(spark, "bookings", "x") != old
