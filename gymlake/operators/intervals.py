"""Overlap of intervals of any start minute and any length, without pairs of a busy person.

``busy_minutes`` turns a person's sessions into minute bitmaps per hour, joined by ``bit_or`` (a
partial aggregate), so a request is tested against one row per hour however many sessions the
person holds.  ``overlap_pairs`` lists pairs where they are the answer: both sides are cut into
time buckets and joined on (key, bucket); a pair that shares several buckets counts in the first
one only.  ``peak_load`` is a sweep over +1/-1 events.

Intervals are [start, end) in whole minutes, ``a.start < b.end AND a.end > b.start``: intervals
that only touch do not overlap; one of length 0 overlaps those that hold its minute strictly
inside.  Rows without a start are left out; a negative length counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.timeutil import start_ts

BUCKET_MINUTES = 240


def minute_of(ts: Column) -> Column:
    """Minutes since 1970 of a wall-clock timestamp."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def as_intervals(sessions: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, s and e (minutes) of sessions or requests."""
    s = minute_of(start_ts("session_date", "session_time"))
    length = F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0))
    return (sessions.select(*keep, s.alias("s"), (s + length).alias("e")).filter("s IS NOT NULL"))


def _bits(lo: str, hi: str) -> str:
    """Bits of the minutes [lo, hi) of the hour ``h``."""
    a, b = f"greatest({lo} - h * 60, 0)", f"least({hi} - h * 60, 60)"
    return f"IF({a} < {b}, shiftleft(1L, CAST({b} AS INT)) - shiftleft(1L, CAST({a} AS INT)), 0L)"


def minute_masks(intervals: DataFrame) -> DataFrame:
    """``intervals`` once per hour ``h`` that they touch, with the minutes that they cover
    (``busy``), hold strictly inside (``inside``), and the minute of one of length 0 (``point``)."""
    return (intervals.withColumn("h", F.expr("explode(sequence(floor(s / 60), floor(greatest(s, e - 1) / 60)))"))
            .withColumn("busy", F.expr(_bits("s", "e"))).withColumn("inside", F.expr(_bits("s + 1", "e")))
            .withColumn("point", F.expr("IF(s = e, shiftleft(1L, CAST(s - h * 60 AS INT)), 0L)")))


def busy_minutes(sessions: DataFrame, who: str) -> DataFrame:
    """(who, h, busy, inside, point): what the non-cancelled sessions of a person hold of an hour."""
    active = as_intervals(sessions.filter(F.lower("status") != "cancelled"), who)
    return (minute_masks(active).groupBy(who, "h")
            .agg(*[F.bit_or(c).alias(f"{c}_{who}") for c in ("busy", "inside", "point")]))


def overlapping(requests: DataFrame, sessions: DataFrame, id_col: str, who: str) -> DataFrame:
    """The ids of requests that overlap some non-cancelled session of the same person."""
    asked = minute_masks(as_intervals(requests, id_col, who))
    held = busy_minutes(sessions, who)
    hit = (F.col("busy").bitwiseAND(F.col(f"busy_{who}")).bitwiseOR(F.col("inside").bitwiseAND(F.col(f"point_{who}")))
           .bitwiseOR(F.col("point").bitwiseAND(F.col(f"inside_{who}"))))
    return asked.join(held, [who, "h"]).filter(hit != 0).select(id_col).distinct()


def overlap_check(requests: DataFrame, sessions: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Every request with whether it overlaps a session of its coach, and of its member."""
    flag = {who: overlapping(requests, sessions, id_col, who).withColumn(f"_{who}", F.lit(True)) for who in ("coach_id", "member_id")}
    return (requests.join(flag["coach_id"], id_col, "left").join(flag["member_id"], id_col, "left")
            .select(*requests.columns, F.coalesce("_coach_id", F.lit(False)).alias("coach_busy"),
                    F.coalesce("_member_id", F.lit(False)).alias("member_busy")))


def overlap_pairs(left: DataFrame, right: DataFrame, key, bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Range join of two interval tables (key, id, s, e): left_id, right_id of every pair of one
    key that overlaps, once."""
    key = [key] if isinstance(key, str) else list(key)

    def cut(side: DataFrame, name: str) -> DataFrame:
        first = F.floor(F.col("s") / bucket_minutes)
        last = F.floor(F.greatest(F.col("s"), F.col("e") - 1) / bucket_minutes)
        return side.select(*key, F.col("id").alias(f"{name}_id"), F.col("s").alias(f"{name}_s"), F.col("e").alias(f"{name}_e"),
                           first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("bucket"))

    return (cut(left, "left").join(cut(right, "right"), [*key, "bucket"])
            .filter("left_s < right_e AND left_e > right_s")
            .filter(F.col("bucket") == F.greatest("left_first", "right_first"))
            .select(*key, "left_id", "right_id"))


def double_bookings(sessions: DataFrame, who: str) -> DataFrame:
    """Pairs of non-cancelled sessions of one person that overlap (first_id < second_id)."""
    rows = as_intervals(sessions.filter(F.lower("status") != "cancelled"), who, "id")
    return (overlap_pairs(rows, rows, who).filter("left_id < right_id")
            .select(who, F.col("left_id").alias("first_id"), F.col("right_id").alias("second_id")))


def peak_load(sessions: DataFrame, who: str) -> DataFrame:
    """Sweep line: per person and date the largest number of sessions under way at once, and the
    first minute of the day at which that many are.

    A session past midnight goes on at minute 0 of the next date.  Events of one minute are added
    up first (partial aggregate), so a window holds at most 1,440 rows of one (person, date).
    """
    rows = as_intervals(sessions.filter(F.lower("status") != "cancelled"), who).filter("s < e")
    days = (rows.withColumn("day", F.expr("explode(sequence(floor(s / 1440), floor((e - 1) / 1440)))"))
            .selectExpr(who, "day", "greatest(s - day * 1440, 0) AS a", "e - day * 1440 AS b"))
    events = (days.select(who, "day", F.explode(F.array(
        F.struct(F.col("a").alias("minute"), F.lit(1).alias("d")), F.struct(F.col("b").alias("minute"), F.lit(-1).alias("d")))).alias("x"))
        .select(who, "day", "x.*").filter("minute < 1440")
        .groupBy(who, "day", "minute").agg(F.sum("d").alias("d")))
    here = Window.partitionBy(who, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    load = events.withColumn("load", F.sum("d").over(here))
    # more load first, then the earlier minute, as one number
    best = load.groupBy(who, "day").agg(F.max(F.col("load") * 1440 + (1439 - F.col("minute"))).alias("best"))
    return best.select(who, F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date"),
                       F.floor(F.col("best") / 1440).alias("peak"), (1439 - F.col("best") % 1440).cast("int").alias("at_minute"))
