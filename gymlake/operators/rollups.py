"""Stored summaries that combine.

Three kinds, each a small table that new days are merged into and any range is read from:

* distinct counts (``coach_days``): members as words of 64 bits, so ``bit_or`` merges days and
  ``bit_count`` counts; a word is one long in a hash aggregate.  (A 4 KB bitmap for each coach and
  day would be larger than the few members that one holds.)  Whole months are stored beside days.
* streaks (``active_masks``): one mask of active days per (member, month) and run summaries that
  combine associatively, whatever the grouping.
* sums (``running_totals``): totals up to each day, any range by the difference of two as-of rows.

Merging is ``bit_or`` or the replacement of whole months, so a merge that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.timeutil import lit_date
from gymlake.operators.filters import RANGE_DAYS
from gymlake.sources.keyed import KeyedTable

DAY, MONTH = "day", "month"
# A coach's rows of one month lie in one of this many parts, so no task gets a month of all coaches.
SHARDS = 16


def _is(status: str) -> Column:
    return F.lower(F.col("status")) == status


def _bit(member: str = "member_id") -> Column:
    """The member's bit in its word (NULL member: NULL, counted nowhere)."""
    return F.expr(f"shiftleft(1L, CAST({member} & 63 AS INT))")


# ---------------------------------------------------------------- distinct members
SUMS, BITS = ["sessions", "completed"], ["members", "completed_members"]


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.bit_or(c).alias(c) for c in BITS])


def coach_days(sessions: DataFrame) -> DataFrame:
    """Per (coach, day, word of 64 member ids): sessions, completed ones, and the members of both
    as bits.  Sessions without a date are in no range and left out; those without a member are
    counted in a NULL word.  Partial aggregates combine a hot coach before the shuffle."""
    rows = sessions.where("session_date IS NOT NULL").select(
        F.lit(DAY).alias("level"), F.col("session_date").alias("start"), "coach_id",
        F.expr("shiftright(CAST(member_id AS BIGINT), 6)").alias("word"),
        F.lit(1).cast("long").alias("sessions"), F.when(_is("completed"), 1).otherwise(0).cast("long").alias("completed"),
        _bit().alias("members"), F.when(_is("completed"), _bit()).alias("completed_members"))
    return _placed(_merged(rows, ["level", "start", "coach_id", "word"]))


def _placed(rows: DataFrame) -> DataFrame:
    """Month and part of each row: the key that it is stored by."""
    return rows.withColumn("month", F.trunc("start", "month")).withColumn(
        "part", F.pmod(F.xxhash64("coach_id"), F.lit(SHARDS)).cast("int"))


def with_months(days: DataFrame) -> DataFrame:
    """Day rows and the rows of their months (bits or-ed, counts added)."""
    months = _merged(days.select(F.lit(MONTH).alias("level"), F.col("month").alias("start"), "coach_id", "word", *SUMS, *BITS),
                     ["level", "start", "coach_id", "word"])
    return days.unionByName(_placed(months))


def store_coach_days(sessions: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """The stored table of days and months, by (month, part)."""
    return KeyedTable.create(with_months(coach_days(sessions)), path, ["month", "part"], buckets)


def replace_days(table: KeyedTable, sessions: DataFrame, days: DataFrame) -> list[int]:
    """Put the days named in ``days`` (session_date) anew from ``sessions``, which holds all their
    sessions: late, changed and withdrawn ones are taken in.  Only the buckets of their months are
    read and replaced, and a second run gives the same table."""
    named = days.select(F.col("session_date").alias("start")).where("start IS NOT NULL").distinct()
    fresh = coach_days(sessions.join(named.withColumnRenamed("start", "session_date"), "session_date", "left_semi"))
    keys = named.select(F.trunc("start", "month").alias("month"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("part"))

    def change(rows: DataFrame) -> DataFrame:
        others = rows.where(F.col("level") == DAY).join(named, "start", "left_anti")
        # the buckets of the named months may hold further months, which are derived again too
        return with_months(others.select(*fresh.columns).unionByName(fresh))
    return table.rewrite(keys, change)


def _covers(lo: Column, hi: Column | None) -> Column:
    """Whether a stored row is part of the range's cover: months that lie in it, and days in it
    whose month does not."""
    month_in = F.col("month") >= lo
    day_in = F.col("start") >= lo
    if hi is not None:
        month_in &= F.last_day("month") <= hi
        day_in &= F.col("start") <= hi
    return F.when(F.col("level") == MONTH, month_in).otherwise(day_in & ~month_in)


def coach_ranges(stored: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Sessions, completed ones and distinct members of both, per coach and range of
    ``{name: (lo, hi or None)}`` (P3 ranges have no end, P5 ranges do); coaches without a session
    in a range have no row there.  One pass whatever the number of ranges: a range of a year reads
    its months and the days at its edges."""
    as_date = lambda d: lit_date(d) if isinstance(d, str) else d
    bounds = {n: (as_date(lo), as_date(hi)) for n, (lo, hi) in ranges.items()}
    starts = F.array_min(F.array(*[lo for lo, _ in bounds.values()]))
    inside = F.array(*[F.when(_covers(lo, hi), F.lit(n)) for n, (lo, hi) in bounds.items()])
    rows = (stored.where(F.col("month") >= F.trunc(starts, "month"))  # a literal: pushed to the scan
            .select("coach_id", "word", *SUMS, *BITS, F.explode(F.array_compact(inside)).alias("range")))
    words = _merged(rows, ["coach_id", "range", "word"])
    return words.groupBy("coach_id", "range").agg(
        F.sum("sessions").alias("sessions"), F.sum("completed").alias("completed"),
        F.coalesce(F.sum(F.bit_count("members")), F.lit(0)).cast("long").alias("unique_members"),
        F.coalesce(F.sum(F.bit_count("completed_members")), F.lit(0)).cast("long").alias("active_members"))


def named_ranges(as_of, names=("week", "month", "quarter", "year")) -> dict[str, tuple]:
    """``{name: (as_of - n days, None)}``."""
    return {n: (F.date_sub(lit_date(as_of), RANGE_DAYS[n]), None) for n in names}


# ---------------------------------------------------------------- streaks
SUMMARY = ["first_day", "last_day", "head", "tail", "longest", "active_days"]


def active_masks(days: DataFrame) -> DataFrame:
    """One mask of active days (bit 0: the first) per (member, month), from rows (member_id, day)."""
    return (days.where("member_id IS NOT NULL AND day IS NOT NULL")
            .groupBy("member_id", F.trunc("day", "month").alias("month"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(day(day) - 1 AS INT))")).alias("mask")))


def merge_masks(*masks: DataFrame) -> DataFrame:
    """Masks of any days, met in any order and any number of times: the bits are or-ed."""
    rows = masks[0]
    for more in masks[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("member_id", "month").agg(F.bit_or("mask").alias("mask"))


def mask_summaries(masks: DataFrame) -> DataFrame:
    """The run summary of each (member, month): first and last active day, length of the runs that
    begin and end there, longest run, active days.  The runs are those of ones in the mask."""
    bits = F.bin("mask")  # from the last active day down
    runs = F.transform(F.filter(F.split(bits, "0+"), lambda r: F.length(r) > 0), lambda r: F.length(r))
    return (masks.where("mask <> 0")
            .select("member_id", "month", "mask", bits.alias("bits"), runs.alias("runs"))
            .select("member_id",
                    F.expr("date_add(month, length(bits) - length(trim(TRAILING '0' FROM bits)))").alias("first_day"),
                    F.expr("date_add(month, length(bits) - 1)").alias("last_day"),
                    F.element_at("runs", -1).alias("head"), F.element_at("runs", 1).alias("tail"),
                    F.array_max("runs").alias("longest"), F.bit_count("mask").alias("active_days")))


def combine(a: Column, b: Column) -> Column:
    """The summary of two spans, ``a`` before ``b``.  Associative, so parts may be combined in any
    grouping that keeps their order."""
    meets = F.datediff(b["first_day"], a["last_day"]) == 1
    whole = lambda s: s["head"] == F.datediff(s["last_day"], s["first_day"]) + 1  # noqa: E731 - one run
    zero = F.lit(0)
    return F.struct(
        a["first_day"].alias("first_day"), b["last_day"].alias("last_day"),
        (a["head"] + F.when(meets & whole(a), b["head"]).otherwise(zero)).alias("head"),
        (b["tail"] + F.when(meets & whole(b), a["tail"]).otherwise(zero)).alias("tail"),
        F.greatest(a["longest"], b["longest"], F.when(meets, a["tail"] + b["head"]).otherwise(zero)).alias("longest"),
        (a["active_days"] + b["active_days"]).alias("active_days"))


def merge_summaries(parts: DataFrame, by=("member_id",)) -> DataFrame:
    """One summary per key from summaries of spans that do not overlap.  A key's list holds one
    entry a part (a month), so it is bounded by the calendar."""
    lists = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*SUMMARY))).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    folded = lists.select(*by, F.aggregate(rest, F.element_at("parts", 1), combine).alias("s"))
    return folded.select(*by, *[F.col(f"s.{c}").alias(c) for c in SUMMARY])


def summary_streaks(summaries: DataFrame, as_of) -> DataFrame:
    """W1 from summaries of the days up to ``as_of``: the current streak is the last run if it ends
    on that day or the day before, else 0."""
    return summaries.select(
        "member_id", F.col("longest").cast("long").alias("longest_streak"),
        F.when(F.col("last_day") >= F.date_sub(lit_date(as_of), 1), F.col("tail")).otherwise(F.lit(0)).cast("long")
        .alias("current_streak"), F.col("active_days").cast("long").alias("active_days"))


def add_days(table: KeyedTable, days: DataFrame) -> list[int]:
    """Merge rows (member_id, day) into a stored table of masks, by member: only the buckets of
    their members are read and replaced; no stored day is scanned again."""
    new = active_masks(days)
    return table.rewrite(new.select("member_id"), lambda rows: merge_masks(rows, new))


def completed_days(sessions: DataFrame) -> DataFrame:
    return sessions.where(_is("completed")).select("member_id", F.col("session_date").alias("day"))


# ---------------------------------------------------------------- running totals
def running_totals(daily: DataFrame, key: str, day: str, values) -> DataFrame:
    """Per key and day with rows: totals of ``values`` and of days up to that day.  ``daily`` has one
    row per (key, day), so a key's window is bounded by the calendar.  Decimals stay exact."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(
        key, F.col(day).alias("day"), *[F.sum(v).over(w).alias(v) for v in values],
        F.count(F.lit(1)).over(w).alias("days"))


def range_totals(totals: DataFrame, requests: DataFrame, key: str, values, sentinel: str = "0001-01-01") -> DataFrame:
    """Sums of ``values`` and number of days with rows for each request (its columns, with ``key``,
    ``lo`` and ``hi``, both inclusive; NULL: open): the total as of ``hi`` less that as of the day
    before ``lo``.  Requests without rows, and with ``lo`` after ``hi``, have 0.

    Both bounds of each request become events among the key's days; one sort per key answers all,
    so neither many requests for a key nor long ranges multiply rows."""
    numbered = requests.withColumn("_bound", F.explode(F.array(F.lit(0), F.lit(1))))
    lo, hi = F.coalesce("lo", F.lit(sentinel).cast("date")), F.coalesce("hi", F.lit("9999-12-31").cast("date"))
    events = numbered.select(
        F.col(key), F.when(F.col("_bound") == 0, F.date_sub(lo, 1)).otherwise(F.greatest(hi, F.date_sub(lo, 1))).alias("day"),
        F.lit(1).alias("_asks"), F.col("_bound"), F.struct(*requests.columns).alias("_request"))
    cols = [*values, "days"]
    known = totals.select(key, "day", F.lit(0).alias("_asks"), F.struct(*cols).alias("_total"))
    w = Window.partitionBy(key).orderBy("day", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = (known.unionByName(events, allowMissingColumns=True)
             .withColumn("_total", F.last("_total", ignorenulls=True).over(w))
             .where(F.col("_asks") == 1))
    # max, not sum: equal requests (with equal totals) are one answer
    of = lambda c, bound: F.max(F.when(F.col("_bound") == bound, F.coalesce(F.col(f"_total.{c}"), F.lit(0))))
    return asked.groupBy("_request").agg(*[(of(c, 1) - of(c, 0)).alias(c) for c in cols]).select("_request.*", *cols)
