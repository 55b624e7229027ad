"""Operators on literal rows: properties and the reference's defects."""

import datetime as dt

from pyspark.sql import functions as F

from gymlake.operators import attendance as at
from gymlake.operators import bookings as bk
from gymlake.operators import scheduling as sc
from gymlake.operators import upserts as up

SESSION_SCHEMA = ("id long, member_id int, coach_id int, gym_id int, session_date date, "
                  "session_time string, duration int, status string, notes string")


def sessions(spark, rows):
    return spark.createDataFrame(rows, SESSION_SCHEMA)


def d(s):
    return dt.date.fromisoformat(s)


def test_streaks_gaps_and_islands(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", "2024-01-09", "2024-01-10"]
    rows = [(i, 1, 1, 1, d(x), "10:00", 60, "Completed", None) for i, x in enumerate(days)]
    rows.append((99, 1, 1, 1, d("2024-01-10"), "18:00", 60, "completed", None))  # same day twice
    r = at.streaks(sessions(spark, rows), "2024-01-11").first()
    assert r["longest_streak"] == 3           # D1: the reference would say 1
    assert r["current_streak"] == 2           # run ends the day before as_of
    assert r["active_days"] == 6              # property: streak <= distinct days


def test_coach_overview_no_fanout(spark):
    coaches = spark.createDataFrame([(1, 1, "Sam", "s@x", "Yoga", "Active"),
                                     (2, 1, "Sam", "t@x", "Yoga", "Active")],
                                    "id int, gym_id int, name string, email string, specialization string, status string")
    mc = spark.createDataFrame([(m, 1) for m in range(5)], "member_id int, coach_id int")
    s = sessions(spark, [(i, i % 5, 1, 1, d("2024-01-01"), "10:00", 60, "Completed", None) for i in range(4)])
    rows = {r["coach_id"]: r for r in at.coach_overview(coaches, mc, s).collect()}
    assert rows[1]["total_sessions"] == 4 and rows[1]["total_members"] == 5   # D2: not 20
    assert rows[2]["total_sessions"] == 0                                      # D14: same name, own row


def test_rollup_total_equals_tiers(spark):
    m = spark.createDataFrame([(1, 1, "Basic"), (2, 1, "VIP"), (3, 1, "VIP"), (4, 2, "Premium")],
                              "id int, gym_id int, membership_type string")
    r = at.monthly_revenue(m).collect()
    for g in (1, 2):
        total = [x["revenue"] for x in r if x["gym_id"] == g and x["membership_type"] is None][0]
        parts = sum(x["revenue"] for x in r if x["gym_id"] == g and x["membership_type"] is not None)
        assert total == parts


def test_no_overlap_when_slot_ends_as_other_starts(spark):
    busy = spark.createDataFrame([(1, dt.datetime(2024, 1, 25, 11, 0), dt.datetime(2024, 1, 25, 12, 0)),
                                  (1, dt.datetime(2024, 1, 25, 15, 30), dt.datetime(2024, 1, 25, 15, 30))],
                                 "coach_id int, s_start timestamp_ntz, s_end timestamp_ntz")
    slots = spark.createDataFrame([(1, dt.datetime(2024, 1, 25, h, 0)) for h in (10, 11, 12, 14, 15)],
                                  "coach_id int, start timestamp_ntz")
    free = sorted(r["start"].hour for r in sc.overlaps_busy(slots, busy, "coach_id", 60).collect())
    # 10:00-11:00 touches 11:00 (no overlap); 15:00-16:00 contains the zero-length 15:30 session
    assert free == [10, 12, 14]


def test_bookings_no_accepted_collision(spark):
    members = spark.createDataFrame([(1, 1, "a", "Basic"), (2, 1, "b", "VIP"), (3, 2, "c", "Basic")],
                                    "id int, gym_id int, name string, membership_type string")
    coaches = spark.createDataFrame([(1, 1), (2, 1)], "id int, gym_id int")
    mc = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "member_id int, coach_id int")
    hist = sessions(spark, [(1, 1, 1, 1, d("2024-01-02"), "10:00", 60, "Scheduled", None)])
    req = spark.createDataFrame([
        (10, 1, 1, d("2024-01-02"), "10:00", 60),   # collides with history
        (11, 1, 2, d("2024-01-03"), "09:00", 60),   # accepted
        (12, 1, 1, d("2024-01-03"), "09:00", 60),   # same coach slot as 11, later -> batch conflict
        (13, 1, 3, d("2024-01-04"), "09:00", 60),   # member in another gym
        (14, 1, 2, d("2024-01-05"), None, 60),      # missing field
    ], "request_id long, coach_id int, member_id int, session_date date, session_time string, duration int")
    out = {r["request_id"]: r for r in bk.validate_bookings(req, members, coaches, mc, hist).collect()}
    assert out[10]["reason"] == bk.REASONS["coach_conflict"]
    assert out[11]["accepted"]
    assert out[12]["reason"] == bk.REASONS["batch_conflict"]
    assert out[13]["reason"] == bk.REASONS["tenancy"]
    assert out[14]["reason"] == bk.REASONS["missing"]
    acc = [r for r in out.values() if r["accepted"]]
    keys = [(r["coach_id"], r["session_date"], r["session_time"]) for r in acc]
    assert len(keys) == len(set(keys))


def test_upsert_idempotent_and_keeps_created(spark):
    base = spark.createDataFrame([(1, "a", 1, dt.datetime(2024, 1, 1))],
                                 "k int, v string, seq long, created_at timestamp_ntz")
    new = spark.createDataFrame([(1, "b", 2, dt.datetime(2024, 2, 1)), (2, "c", 1, dt.datetime(2024, 2, 1))],
                                "k int, v string, seq long, created_at timestamp_ntz")
    once = up.upsert(base, new, "k", "seq")
    twice = up.upsert(once, new, "k", "seq")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert a[0] == (1, "b", 2, dt.datetime(2024, 1, 1))


def test_latest_n_unique_tiebreak(spark):
    s = sessions(spark, [(i, 1, 1, 1, d("2024-01-01"), "10:00", 60, "Completed", None) for i in range(8)])
    r = at.latest_n(s, "member_id", [F.desc("session_date"), F.desc("session_time"), F.desc("id")], 5)
    assert sorted(x["id"] for x in r.collect()) == [3, 4, 5, 6, 7]


def test_softmax_topk_matches_numpy(spark):
    import numpy as np

    from gymlake.operators import foods as fd
    rows = [(1, [1.0, 3.0, 2.0, 3.0]),          # tie on the max: lower index first
            (2, [0.0, -800.0, -900.0, -1000.0]),  # exp underflows to 0: index order
            (3, [5.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["top"] for r in fd.softmax_topk(df, "embedding", 3).collect()}
    for vid, logits in rows:
        x = np.asarray(logits, dtype=np.float32).astype(np.float64)
        p = np.exp(x - x.max())
        p = p / p.sum()
        order = sorted(range(len(p)), key=lambda i: (-p[i], i))[:3]
        assert [t["label_id"] for t in got[vid]] == order
        assert [t["label"] for t in got[vid]] == [f"class_{i}" for i in order]
        assert np.allclose([t["confidence"] for t in got[vid]], p[order])


def test_member_counters_and_streaks_equal_separate_operators(spark):
    import random
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), 1, 1, d("2024-01-01") + dt.timedelta(days=rng.randrange(60)), "10:00", 60,
             rng.choice(["Completed", "completed", "Cancelled", "Scheduled", "No-show"]), None)
            for i in range(1500)]
    s = sessions(spark, rows)
    as_of = "2024-02-10"                  # days after as_of exist and must not extend runs
    one = {r["member_id"]: r.asDict() for r in at.member_counters_and_streaks(s, as_of).collect()}
    stats = {r["member_id"]: r.asDict() for r in at.session_stats(s, "member_id", as_of).collect()}
    st = {r["member_id"]: r.asDict() for r in at.streaks(s, as_of).collect()}
    assert set(one) == set(stats)
    for m, r in one.items():
        for k, v in stats[m].items():
            assert r[k] == v, (m, k)
        assert r["longest_streak"] == st.get(m, {}).get("longest_streak", 0)
        assert r["current_streak"] == st.get(m, {}).get("current_streak", 0)
