"""Hot keys: one coach or member holding a third of all rows.

Results must not change when one key dominates, and must not change when AQE
splits the hot partitions (skew join forced on with tiny thresholds).  Small
fixtures are checked against brute force.
"""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from gymlake.operators import attendance as at
from gymlake.operators import scheduling as sc
from gymlake.sources.tables import Tables

SF = "/root/testdata/sf0.01"


def _sessions_with_hot_coach(rng, n=900, hot=1):
    base = dt.datetime(2024, 1, 22, 6, 0)
    rows = []
    for i in range(n):
        coach = hot if i % 3 == 0 else rng.randint(2, 40)
        start = base + dt.timedelta(minutes=15 * rng.randint(0, 4 * 24 * 6))
        dur = rng.choice([0, 30, 45, 60, 90, 150])
        rows.append((i, coach, start, start + dt.timedelta(minutes=dur)))
    return rows


def test_overlap_filter_matches_brute_force_with_hot_coach(spark):
    rng = random.Random(7)
    rows = _sessions_with_hot_coach(rng)
    busy = spark.createDataFrame(rows, "id long, coach_id int, s_start timestamp_ntz, s_end timestamp_ntz")
    starts = [dt.datetime(2024, 1, 22, 0, 0) + dt.timedelta(hours=h) for h in range(24 * 7)]
    coaches = sorted({r[1] for r in rows}) + [999]          # 999 has no sessions
    slots = spark.createDataFrame([(c, t) for c in coaches for t in starts],
                                  "coach_id int, start timestamp_ntz")
    got = {(r["coach_id"], r["start"]) for r in sc.overlaps_busy(slots, busy, "coach_id", 60).collect()}
    by_coach = {}
    for _, c, s, e in rows:
        by_coach.setdefault(c, []).append((s, e))
    want = {(c, t) for c in coaches for t in starts
            if not any(s < t + dt.timedelta(minutes=60) and e > t for s, e in by_coach.get(c, []))}
    assert got == want


def test_latest_n_with_hot_member(spark):
    rows = [(i, 1 if i % 3 == 0 else 2 + i % 50, 1, 1,
             dt.date(2024, 1, 1) + dt.timedelta(days=i % 200), f"{8 + i % 12:02d}:00", 60, "Completed", None)
            for i in range(3000)]
    s = spark.createDataFrame(rows, "id long, member_id int, coach_id int, gym_id int, session_date date, "
                                    "session_time string, duration int, status string, notes string")
    order = [F.desc("session_date"), F.desc("session_time"), F.desc("id")]
    got = {}
    for r in at.latest_n(s, "member_id", order, 5).collect():
        got.setdefault(r["member_id"], []).append((r["rank_in_group"], r["id"]))
    want = {}
    for r in sorted(rows, key=lambda x: (x[4], x[5], x[0]), reverse=True):
        if len(want.setdefault(r[1], [])) < 5:
            want[r[1]].append(r[0])
    assert {m: [i for _, i in sorted(v)] for m, v in got.items()} == want


FORCED_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


# the page is cut before its joins, and a hot coach's pairs are dealt over salted copies of one
# row a person, so no hot partition is left to split in them
@pytest.mark.parametrize("name,splits", [("match_slots", False), ("member_session_page", False),
                                         ("export_members_gym", True)])
def test_same_answer_when_aqe_splits_hot_partitions(spark, name, splits):
    q = se.queries()[name]
    normal = sorted(map(tuple, q(spark, SF).collect()), key=repr)
    old = {k: spark.conf.get(k, None) for k in FORCED_SKEW}
    try:
        for k, v in FORCED_SKEW.items():
            spark.conf.set(k, v)
        df = q(spark, SF)
        split = sorted(map(tuple, df.collect()), key=repr)
        assert ("skew=true" in _plan(df)) == splits  # AQE really split a partition
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert split == normal


def test_coach_overview_with_hot_coach_matches_brute_force(spark):
    rng = random.Random(11)
    coaches = spark.createDataFrame([(c, 1, f"c{c}", None, None, "Active") for c in range(1, 21)],
                                    "id int, gym_id int, name string, email string, "
                                    "specialization string, status string")
    links = [(m, 1 if m % 3 == 0 else 2 + m % 19) for m in range(600)]
    mc = spark.createDataFrame(links, "member_id int, coach_id int")
    rows = [(i, rng.randrange(600), 1 if i % 3 == 0 else 2 + i % 19, 1,
             dt.date(2024, 1, 1) + dt.timedelta(days=i % 60), "10:00", 60,
             rng.choice(["Completed", "completed", "Cancelled", "Scheduled"]), None) for i in range(5000)]
    s = spark.createDataFrame(rows, "id long, member_id int, coach_id int, gym_id int, session_date date, "
                                    "session_time string, duration int, status string, notes string")
    got = {r["coach_id"]: (r["total_members"], r["total_sessions"], r["completed_sessions"])
           for r in at.coach_overview(coaches, mc, s).collect()}
    for c in range(1, 21):
        members = {m for m, cc in links if cc == c}
        mine = [r for r in rows if r[2] == c]
        done = sum(1 for r in mine if r[7].lower() == "completed")
        assert got[c] == (len(members), len(mine), done)


@pytest.mark.parametrize("now", ["2024-01-25 10:30:00", "2024-01-25 10:00:00", "2024-01-23 23:59:59"])
def test_week_cells_equal_timestamp_overlap(spark, now):
    """The (weekday, hour) anti-join of slot matching equals the timestamp test."""
    from gymlake.functions.timeutil import lit_ts, next_occurrence
    rng = random.Random(3)
    rows = _sessions_with_hot_coach(rng, n=600)
    busy = spark.createDataFrame(rows, "id long, coach_id int, s_start timestamp_ntz, s_end timestamp_ntz")
    coaches = sorted({r[1] for r in rows})
    cells = spark.createDataFrame([(c, d, h) for c in coaches for d in range(7) for h in range(24)],
                                  "coach_id int, dow int, hour int")
    by_cell = cells.join(sc.blocked_week_cells(busy, "coach_id", 60, lit_ts(now)),
                         ["coach_id", "dow", "hour"], "left_anti")
    with_start = cells.withColumn("start", next_occurrence(F.col("dow"), F.col("hour"), lit_ts(now)))
    by_time = sc.overlaps_busy(with_start, busy, "coach_id", 60).drop("start")
    got = {tuple(r) for r in by_cell.collect()}
    assert got == {tuple(r) for r in by_time.collect()}
    assert 0 < len(got) < len(coaches) * 168


def test_hour_grid_does_not_depend_on_session_time_zone(spark):
    """Wall-clock overlap must hold under a half-hour-offset session zone too."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        test_overlap_filter_matches_brute_force_with_hot_coach(spark)
        test_week_cells_equal_timestamp_overlap(spark, "2024-01-25 10:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_the_pairs_of_a_hot_coach_are_spread(spark):
    pairs = spark.range(4000).selectExpr("IF(id % 3 = 0, CAST(id % 50 AS INT), 1) AS coach_id", "CAST(id AS INT) AS member_id")
    dealt = (pairs.withColumn("salt", F.pmod(F.xxhash64("member_id"), F.lit(sc.SALTS)).cast("int"))
             .groupBy("coach_id", "salt").count().agg(F.max("count")).first()[0])
    assert dealt <= 1.5 * 4000 / sc.SALTS
    t = Tables(spark, SF)
    plan = _plan(sc.match_slots(t.member_coach, t.free_days, t.user_preferences, t.sessions, "2024-01-25 10:30:00"))
    assert "salt" in plan
