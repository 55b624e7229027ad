"""Hours of a day as the bits of one long (bit h is hour h).

A person's weekly pattern is one row with seven masks, a day's availability one mask per
(person, date).  Free hours are ``open & ~busy``, hours common to two people ``a & b``, their
number ``bit_count``; only hours that survive become rows.  ``bit_or`` combines partially on the
map side, so a person with very many rows costs no more to shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.timeutil import lit_date, to_hour, weekday_from_name



def _one() -> Column:
    return F.lit(1).cast("long")


def hour_bit(hour: Column) -> Column:
    """The bit of an hour; 0 for NULL and hours outside 0-23."""
    bit = F.call_function("shiftleft", _one(), hour.cast("int"))
    return F.when(hour.between(0, 23), bit).otherwise(F.lit(0).cast("long"))


def range_mask(start: Column, end: Column) -> Column:
    """Bits of the hours [start, end), cut to the day; 0 where a bound is NULL or none is left."""
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.lit(24))
    mask = F.call_function("shiftleft", _one(), hi.cast("int")) - F.call_function("shiftleft", _one(), lo.cast("int"))
    return F.when(start.isNotNull() & end.isNotNull() & (lo < hi), mask).otherwise(F.lit(0).cast("long"))


def without(mask: Column, taken: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(taken))


def has_hour(mask: Column, hour: Column) -> Column:
    return F.call_function("shiftright", mask, hour.cast("int")).bitwiseAND(F.lit(1)) == 1


def hours_of(mask: Column) -> Column:
    """The hours of a mask, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: has_hour(mask, h))


def array_mask(hours: Column) -> Column:
    """The mask of an array of hours (0 for NULL)."""
    return F.coalesce(F.aggregate(hours, F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(hour_bit(h))), F.lit(0).cast("long"))


def week_masks(rows: DataFrame, key, dow: Column, mask: Column, out: str = "week") -> DataFrame:
    """One row per key: ``out``, the masks of Monday to Sunday.  Rows of one day are united."""
    key = [key] if isinstance(key, str) else list(key)
    days = ", ".join(f"coalesce(bit_or(CASE WHEN _dow = {d} THEN _mask END), 0L)" for d in range(7))
    return (rows.select(*key, dow.alias("_dow"), mask.alias("_mask")).filter(F.col("_dow").isNotNull())
            .groupBy(*key).agg(F.expr(f"array({days})").alias(out)))


def weekly_pattern(free_days: DataFrame, hours: tuple[int, int] | None = None) -> DataFrame:
    """(user_id, user_type, week).  With ``hours``, an unknown bound counts as 8 and 20 and
    the masks are cut to the range (J17); without, a day with an unknown bound is closed (X1)."""
    start, end = to_hour("start_time"), to_hour("end_time")
    if hours is None:
        mask = range_mask(start, end)
    else:
        mask = range_mask(F.coalesce(start, F.lit(8)), F.coalesce(end, F.lit(20))).bitwiseAND(F.lit(span(hours)))
    return week_masks(free_days.filter("is_available"), ["user_id", "user_type"], weekday_from_name("day_of_week"), mask)


def span(hours: tuple[int, int]) -> int:
    """The mask of the hours [first, last)."""
    return (1 << hours[1]) - (1 << hours[0])


def override_masks(slots: DataFrame, lo, hi, hours: tuple[int, int]) -> DataFrame:
    """(user_id, user_type, date, opened, closed): what the date overrides of [lo, hi] say."""
    bit = hour_bit(F.col("hour"))
    none = F.lit(0).cast("long")
    return (slots.filter(F.col("slot_date").between(lit_date(lo), lit_date(hi))
                         & F.col("hour").between(hours[0], hours[1] - 1) & F.col("is_available").isNotNull())
            .groupBy("user_id", "user_type", F.col("slot_date").alias("date"))
            .agg(F.coalesce(F.bit_or(F.when(F.col("is_available"), bit)), none).alias("opened"),
                 F.coalesce(F.bit_or(F.when(~F.col("is_available"), bit)), none).alias("closed")))


def effective_masks(users: DataFrame, slots: DataFrame, free_days: DataFrame, lo, hi,
                    hours: tuple[int, int]) -> DataFrame:
    """(user_id, user_type, date, free): one row per user and date of [lo, hi] with some
    available hour.  A date override wins over the weekly pattern (an hour that is both opened
    and closed counts as open); no information means unavailable."""
    who = users.select("user_id", "user_type").distinct()
    key = ["user_id", "user_type", "date"]
    week = weekly_pattern(free_days, hours).join(who, ["user_id", "user_type"], "left_semi")
    dates = (week.withColumn("date", F.explode(F.sequence(lit_date(lo), lit_date(hi))))
             .select(*key, F.get("week", F.weekday("date")).alias("open")).filter("open != 0"))
    over = override_masks(slots, lo, hi, hours).join(who, ["user_id", "user_type"], "left_semi")
    none = F.lit(0).cast("long")
    both = dates.join(over, key, "full")
    free = without(F.coalesce("open", none), F.coalesce("closed", none)).bitwiseOR(F.coalesce("opened", none))
    return both.select(*key, free.alias("free")).filter("free != 0")


def common_free_hours(pairs: DataFrame, slots: DataFrame, free_days: DataFrame, sessions: DataFrame, lo, hi,
                      hours: tuple[int, int]) -> DataFrame:
    """U3/J17 per date: the hours of [lo, hi] that coach and member of a pair both have free,
    less the hours in which either has a session (cancelled ones do not count).

    Returns coach_id, member_id, date, free (mask), free_hours (their number); dates without a
    common hour are left out.
    """
    pairs = pairs.select("coach_id", "member_id").distinct()
    users = (pairs.select(F.col("coach_id").alias("user_id"), F.lit("coach").alias("user_type"))
             .unionByName(pairs.select(F.col("member_id").alias("user_id"), F.lit("member").alias("user_type"))))
    masks = effective_masks(users, slots, free_days, lo, hi, hours)
    busy = busy_masks(sessions, lo, hi)

    def side(kind: str) -> DataFrame:
        who = f"{kind}_id"
        taken = (busy.groupBy(who, "date").agg(F.bit_or("busy").alias("busy")))
        return (masks.filter(F.col("user_type") == kind).select(F.col("user_id").alias(who), "date", "free")
                .join(taken, [who, "date"], "left")
                .select(who, "date", without(F.col("free"), F.coalesce("busy", F.lit(0).cast("long"))).alias(f"_{kind}"))
                .filter(F.col(f"_{kind}") != 0))

    both = pairs.join(side("member"), "member_id").join(side("coach"), ["coach_id", "date"])
    free = F.col("_member").bitwiseAND(F.col("_coach"))
    return (both.select("coach_id", "member_id", "date", free.alias("free")).filter("free != 0")
            .withColumn("free_hours", F.bit_count("free")))


def busy_masks(sessions: DataFrame, lo, hi) -> DataFrame:
    """(coach_id, member_id, date, busy): the hours that each session of [lo, hi] touches on its
    own date; a session past midnight is cut there (the next date is another day's plan)."""
    minutes = F.split("session_time", ":")
    start = minutes.getItem(0).try_cast("int") * 60 + F.get(minutes, 1).try_cast("int")
    first = F.floor(start / 60).cast("int")
    last = F.ceil((start + F.greatest(F.col("duration"), F.lit(1))) / 60).cast("int")
    return (sessions.filter((F.lower("status") != "cancelled")
                            & F.col("session_date").between(lit_date(lo), lit_date(hi)))
            .select("coach_id", "member_id", F.col("session_date").alias("date"), range_mask(first, last).alias("busy")))


