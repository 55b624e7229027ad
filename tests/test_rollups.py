"""Stored summaries that combine, and deep pages, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gymlake.operators import rollups as ru
from gymlake.operators.ordering import deep_page, paginate
from gymlake.sources.keyed import KeyedTable, fresh_path

DAY0 = dt.date(2023, 11, 20)
SESSION = "coach_id int, member_id int, session_date date, status string"
RANGES = {"year": ("2023-01-01", None), "month": ("2023-12-01", "2023-12-31"), "edge": ("2023-11-25", "2024-02-03"),
          "one": ("2024-01-10", "2024-01-10"), "none": ("2030-01-01", None), "turned": ("2024-01-10", "2024-01-09")}


def random_sessions(rnd, n=600):
    ids = [-70, -64, -1, 0, 63, 64, 65, 127, 128, 2_000_000_000, None]
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice(ids), DAY0 + dt.timedelta(rnd.randrange(90)),
             rnd.choice(["Completed", "completed", "Scheduled", None])) for _ in range(n)]
    return rows + [(1, 5, None, "Completed"), (9, None, DAY0, "Completed")]


def brute_ranges(rows):
    out = {}
    for name, (lo, hi) in RANGES.items():
        for coach in {r[0] for r in rows}:
            inside = [r for r in rows if r[0] == coach and r[2] and str(r[2]) >= lo and (hi is None or str(r[2]) <= hi)]
            done = [r for r in inside if (r[3] or "").lower() == "completed"]
            if inside:
                out[coach, name] = (len(inside), len(done), len({r[1] for r in inside} - {None}), len({r[1] for r in done} - {None}))
    return out


def got_ranges(stored):
    return {(r.coach_id, r.range): (r.sessions, r.completed, r.unique_members, r.active_members)
            for r in ru.coach_ranges(stored, RANGES).collect()}


def test_ranges_from_days_and_months(spark):
    rows = random_sessions(random.Random(1))
    stored = ru.with_months(ru.coach_days(spark.createDataFrame(rows, SESSION)))
    assert got_ranges(stored) == brute_ranges(rows)
    assert got_ranges(ru.with_months(ru.coach_days(spark.createDataFrame([], SESSION)))) == {}


def test_replaced_days_take_in_late_changed_and_withdrawn_sessions(spark):
    rnd = random.Random(2)
    before = random_sessions(rnd)
    changed = [DAY0 + dt.timedelta(d) for d in (3, 50, 200)]  # the last is a new month
    after = ([r for r in before if r[2] not in changed]
             + [(2, m, d, "Completed") for d in changed for m in (1, 2, 900)])
    table = ru.store_coach_days(spark.createDataFrame(before, SESSION), fresh_path(spark, "t"))
    now, days = spark.createDataFrame(after, SESSION), spark.createDataFrame([(d,) for d in changed], "session_date date")
    for _ in range(2):  # again: nothing changes
        touched = ru.replace_days(table, now, days)
        assert got_ranges(table.read()) == brute_ranges(after)
    assert len(touched) < table.buckets
    gone = [r for r in after if r[2] != changed[2]]  # a month that loses all its rows
    ru.replace_days(table, spark.createDataFrame(gone, SESSION), days)
    assert got_ranges(table.read()) == brute_ranges(gone)


def brute_summary(days):
    runs, days = [], sorted(days)
    for d in days:
        if runs and d - runs[-1][-1] == dt.timedelta(1):
            runs[-1].append(d)
        else:
            runs.append([d])
    return days[0], days[-1], len(runs[0]), len(runs[-1]), max(map(len, runs)), len(days)


def random_days(rnd):
    return {m: {DAY0 + dt.timedelta(d) for d in range(130) if rnd.random() < share}
            for m, share in [(1, 0.1), (2, 0.5), (3, 0.9), (4, 0.98), (5, 1.0)]} | {6: {dt.date(2024, 2, 29)}, 7: {
                dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 3, 1)}}


def summaries(spark, df):
    return {r.member_id: tuple(r)[1:] for r in ru.merge_summaries(df).collect()}


def test_summaries_combine_in_any_grouping(spark):
    for seed in range(3):
        days = random_days(random.Random(seed))
        rows = [(m, d) for m, ds in days.items() for d in ds]
        parts = ru.mask_summaries(ru.active_masks(spark.createDataFrame(rows + rows + [(None, DAY0), (8, None)], "member_id int, day date")))
        expected = {m: brute_summary(ds) for m, ds in days.items() if ds}
        assert summaries(spark, parts) == expected
        for cut in ("year", "quarter"):
            grouped = ru.merge_summaries(parts.withColumn("g", F.trunc("first_day", cut)), ["member_id", "g"])
            assert summaries(spark, grouped) == expected


def test_days_are_added_one_by_one_in_any_order(spark):
    days = random_days(random.Random(5))
    rows = [(m, d) for m, ds in days.items() for d in ds]
    random.Random(6).shuffle(rows)
    schema = "member_id int, day date"
    table = KeyedTable.create(ru.active_masks(spark.createDataFrame(rows[:100], schema)), fresh_path(spark, "m"), "member_id", 4)
    for part in (rows[100:101], rows[90:200], rows[200:]):  # one repeats stored days
        ru.add_days(table, spark.createDataFrame(part, schema))
    assert summaries(spark, ru.mask_summaries(table.read())) == {m: brute_summary(ds) for m, ds in days.items()}
    assert len(ru.add_days(table, spark.createDataFrame(rows[:1], schema))) == 1
    assert ru.add_days(table, spark.createDataFrame([], schema)) == []


def test_current_streak_ends_today_or_yesterday(spark):
    rows = [(1, dt.date(2024, 1, 25)), (1, dt.date(2024, 1, 24)), (2, dt.date(2024, 1, 24)), (3, dt.date(2024, 1, 23))]
    out = ru.summary_streaks(ru.merge_summaries(ru.mask_summaries(ru.active_masks(
        spark.createDataFrame(rows, "member_id int, day date")))), "2024-01-25")
    assert {r.member_id: (r.longest_streak, r.current_streak) for r in out.collect()} == {1: (2, 2), 2: (1, 1), 3: (1, 0)}


def test_range_totals(spark):
    rnd = random.Random(3)
    daily = {(k, DAY0 + dt.timedelta(d)): rnd.randrange(1000) for k in (1, 2) for d in rnd.sample(range(60), 30)}
    rows = [(k, d, v, None if v % 3 == 0 else v) for (k, d), v in daily.items()] + [(None, DAY0, 1, 1), (1, None, 7, 7)]
    totals = ru.running_totals(spark.createDataFrame(rows, "k int, d date, v int, w int"), "k", "d", ["v", "w"])
    bound = lambda: rnd.choice([None, DAY0 + dt.timedelta(rnd.randrange(-5, 66))])
    asked = [(i, rnd.choice([1, 2, 3, None]), bound(), bound()) for i in range(80)]
    asked += [(100, 1, DAY0, DAY0)] * 3  # repeated requests are one answer
    out = ru.range_totals(totals, spark.createDataFrame(asked, "id int, k int, lo date, hi date"), "k", ["v", "w"]).collect()
    assert len(out) == 81
    for r in out:
        inside = [v for (k, d), v in daily.items() if k == r.k and (r.lo is None or d >= r.lo) and (r.hi is None or d <= r.hi)]
        assert (r.v, r.w, r.days) == (sum(inside), sum(v for v in inside if v % 3), len(inside)), r


ORDER = [("d", False), ("t", True), ("id", False)]


@pytest.mark.parametrize("page, limit, slices", [(1, 7, 2), (3, 7, 2), (9, 7, 1), (12, 10, 2), (40, 7, 2), (5, 1, 3), (1, 1000, 1)])
def test_deep_pages_equal_pages(spark, page, limit, slices):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(9)]), rnd.choice("abc")) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k int, d int, t string")
    directed = [F.desc("d"), F.asc("t"), F.desc("id")]
    wanted = paginate(df, "k", directed, page, limit).where("k IS NOT NULL")
    got = deep_page(df, "k", ORDER, slices, page, limit)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.where("k IS NOT NULL").select(*wanted.columns).collect()), key=key) == sorted(
        map(tuple, wanted.collect()), key=key)


def test_deep_page_of_one_hot_key(spark):
    df = spark.range(0, 40_000).selectExpr("id", "1 AS k", "CAST(id DIV 50 AS INT) AS d", "'a' AS t")
    got = deep_page(df, "k", ORDER, 2, page=1000, limit=20)
    assert [r.id for r in got.orderBy("row_in_group").collect()] == [
        d * 50 + i for d in (400,) for i in range(19, -1, -1)] and got.first().total == 40_000


@pytest.mark.parametrize("page, limit, slices", [(0, 5, 1), (1, 0, 1), (1, 1001, 1), (1, 5, 0), (1, 5, 4)])
def test_deep_page_refuses(spark, page, limit, slices):
    with pytest.raises(ValueError):
        deep_page(spark.range(1).selectExpr("id", "id AS k", "id AS d", "id AS t"), "k", ORDER, slices, page, limit)
