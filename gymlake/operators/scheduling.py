"""Availability, slot matching and grids.

Weekly availability is seven hour masks per person (``hour_masks``): pair joins see one
row a person, and only hours that survive become rows.  The interval-overlap test (J10) turns each busy interval into the hour-aligned slot
starts it blocks and anti-joins candidates on (person, start hour): exact, and
no pair of intervals is ever enumerated, so a coach that owns a third of all
sessions costs the same per session as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.operators import hour_masks as hm
from gymlake.operators.filters import to_nested_session
from gymlake.functions.timeutil import (WEEKDAYS, hours_to_block, lit_date, lit_ts, next_occurrence,
                                        start_ts, to_hour, weekday_from_name)

HOUR_US = 3_600_000_000  # microseconds per hour
# Wall-clock origin of the hour grid.  Offsets are taken between TIMESTAMP_NTZ
# values, so the grid does not depend on the session time zone.
def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)
# Hours shown in the group availability heat-map (8:00 .. 21:00).
GROUP_HOURS = (8, 22)
# Copies of a coach's week among which the coach's pairs are dealt.
SALTS = 16
PREFERRED_SLOTS_SCHEMA = "array<string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- X1
def expand_weekly(free_days: DataFrame) -> DataFrame:
    """Available weekdays -> one row per (user, weekday, hour) in [start, end)."""
    start, end = to_hour("start_time"), to_hour("end_time")
    fd = free_days.filter(F.col("is_available") & start.isNotNull() & end.isNotNull() & (end > start))
    return fd.select("user_id", "user_type", "day_of_week",
                     weekday_from_name("day_of_week").alias("dow"),
                     F.explode(F.sequence(start, F.least(end, F.lit(24)) - 1)).alias("hour"))


def preferred_hours(prefs: DataFrame) -> DataFrame:
    """Preferred time slots JSON -> array of INT hours (malformed or NULL -> [])."""
    parsed = F.from_json(F.col("preferred_time_slots"), PREFERRED_SLOTS_SCHEMA)
    hours = F.array_distinct(F.filter(F.transform(parsed, lambda s: to_hour(s)),
                                      lambda h: h.isNotNull()))
    return prefs.select("user_id", "user_type",
                        F.coalesce(hours, F.array().cast("array<int>")).alias("pref_hours"))


def _prefs_for(prefs: DataFrame, user_type: str, id_col: str, out: str) -> DataFrame:
    return (preferred_hours(prefs).filter(F.col("user_type") == user_type)
            .select(F.col("user_id").alias(id_col), F.col("pref_hours").alias(out)))


def score(coach_pref: Column, member_pref: Column) -> Column:
    """U4: 4 both prefer, 3 coach only, 2 member only, 1 neither."""
    cp, mp = F.coalesce(coach_pref, F.lit(False)), F.coalesce(member_pref, F.lit(False))
    return F.when(cp & mp, 4).when(cp, 3).when(mp, 2).otherwise(1)


# ---------------------------------------------------------------- J10
def session_intervals(sessions: DataFrame) -> DataFrame:
    """Sessions as [start, end) timestamps (NTZ) with person keys."""
    st = start_ts("session_date", "session_time")
    return sessions.select("id", "coach_id", "member_id", st.alias("s_start"),
                           F.timestamp_add("MINUTE", F.col("duration"), st).alias("s_end"))


def blocked_starts(intervals: DataFrame, key: str, duration: int) -> DataFrame:
    """J10 on the hour grid: the hour-aligned starts ``t`` whose slot [t, t + duration)
    overlaps some busy interval [s, e) of the same ``key``, i.e. ``s - duration < t < e``.

    Each interval yields at most ``(e - s + duration) / 1h + 1`` starts, and the
    result is de-duplicated with a partial aggregate, so the later overlap test is
    a plain equi anti-join: no pair of intervals is ever enumerated, however many
    sessions one coach or member holds.
    """
    s_us = _micros(F.col("s_start").cast("timestamp_ntz"))
    e_us = _micros(F.col("s_end").cast("timestamp_ntz"))
    d_us = F.lit(duration * 60_000_000)
    k_lo = F.floor((s_us - d_us) / HOUR_US) + 1
    k_hi = F.ceil(e_us / HOUR_US) - 1
    return (intervals.filter(k_hi >= k_lo)
            .select(F.col(key), F.explode(F.sequence(k_lo, k_hi)).alias("start_hour_index"))
            .distinct())


def hour_index(ts: Column) -> Column:
    return F.floor(_micros(ts.cast("timestamp_ntz")) / HOUR_US)


def blocked_week_cells(intervals: DataFrame, key: str, duration: int, now) -> DataFrame:
    """J10 for weekly slots: the (weekday, hour) cells whose next occurrence after
    ``now`` is blocked for ``key``.

    Every next occurrence (F13) lies in ``(now, now + 7 days]``, and that window
    holds exactly one hour-aligned instant per (weekday, hour); so a blocked start
    inside it names its cell, and one outside it blocks no candidate.  The mapping
    runs on the (small) busy side, and candidates are removed by an equi anti-join
    on (person, weekday, hour) without computing a timestamp per candidate.
    """
    now = _c(now)
    t = F.timestamp_add("HOUR", F.col("start_hour_index"), _epoch())
    return (blocked_starts(intervals, key, duration)
            .filter((t > now) & (t <= F.timestamp_add("DAY", F.lit(7), now)))
            .select(F.col(key), F.weekday(t).alias("dow"), F.hour(t).alias("hour")))


def overlaps_busy(slots: DataFrame, busy: DataFrame, key: str, duration: int,
                  start_col: str = "start") -> DataFrame:
    """Hour-aligned slots of length ``duration`` minutes that overlap no busy
    interval of the same person (``slot.start < busy.end AND slot.end > busy.start``)."""
    blocked = blocked_starts(busy, key, duration)
    return (slots.withColumn("start_hour_index", hour_index(F.col(start_col)))
            .join(blocked, [key, "start_hour_index"], "left_anti")
            .drop("start_hour_index"))


# ---------------------------------------------------------------- X2
def _week_of(free_days: DataFrame, user_type: str, who: str) -> DataFrame:
    """(``who``, week): the weekly masks of the users of one type."""
    return (hm.weekly_pattern(free_days.filter(F.col("user_type") == user_type))
            .select(F.col("user_id").alias(who), "week"))


def _free_week(free_days: DataFrame, busy: DataFrame, user_type: str, duration: int, now) -> DataFrame:
    """(``<user_type>_id``, <user_type>_0 .. _6): per weekday the hours less those whose next
    occurrence is blocked (J10)."""
    who = f"{user_type}_id"
    taken = hm.week_masks(blocked_week_cells(busy, who, duration, now), who, F.col("dow"), hm.hour_bit(F.col("hour")), "taken")
    return (_week_of(free_days, user_type, who).join(taken, who, "left")
            .selectExpr(who, *[f"week[{d}] & ~coalesce(taken[{d}], 0L) AS {user_type}_{d}" for d in range(7)]))


def match_slots(pairs: DataFrame, free_days: DataFrame, prefs: DataFrame, sessions: DataFrame,
                now, duration: int = 60, top_n: int = 10) -> DataFrame:
    """Best weekly slots for every coach-member pair.

    common weekly slots -> next occurrence strictly after ``now`` (F13) -> drop
    slots overlapping a non-cancelled coach or member session from today on
    (J10) -> preference score (U4) -> top ``top_n`` by score then time (W4).

    A slot's start depends only on (weekday, hour), and whether it is blocked only
    on (person, start), so each person has one row: seven hour masks less the blocked
    cells.  A pair's common hours are the ``&`` of two rows, split by score (preference
    masks) and by date of the week ahead: 32 masks in the order of the result.  Counting
    their bits tells where each begins, so the first masks that hold ``top_n`` hours are
    known inside the pair's row; only those become rows.  Nothing is shuffled after the
    pair join, and no pair's candidates are sorted.
    """
    now_ts = lit_ts(now)
    today = F.to_date(now_ts)
    horizon = F.date_add(today, 8 + duration // 1440)
    busy = session_intervals(sessions.filter(
        (F.lower("status") != "cancelled") & (F.col("session_date") >= today)
        & (F.col("session_date") <= horizon)))
    cp = _prefs_for(prefs, "coach", "coach_id", "pref").select("coach_id", hm.array_mask(F.col("pref")).alias("cp"))
    mp = _prefs_for(prefs, "member", "member_id", "pref").select("member_id", hm.array_mask(F.col("pref")).alias("mp"))
    member = _free_week(free_days, busy, "member", duration, now_ts).join(mp, "member_id", "left")
    coach = _free_week(free_days, busy, "coach", duration, now_ts).join(cp, "coach_id", "left")
    # a coach may hold a third of all pairs: those are dealt over SALTS copies of the coach's row
    salted = (pairs.select("coach_id", "member_id").distinct().join(member, "member_id")
              .withColumn("salt", F.pmod(F.xxhash64("member_id"), F.lit(SALTS)).cast("int")))
    copies = coach.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    common = (salted.join(copies, ["coach_id", "salt"])
              .withColumn("now", now_ts)
              .selectExpr("coach_id", "member_id", "now", "coalesce(cp, 0L) AS cp", "coalesce(mp, 0L) AS mp",
                          *[f"coach_{d} & member_{d} AS m{d}" for d in range(7)]))
    # the week ahead: what is left of today, six days, and today's hours a week later
    past = "(shiftleft(1L, hour(now) + 1) - 1)"
    week = "array(" + ", ".join(f"m{d}" for d in range(7)) + ")"
    dates = [f"{week}[pmod(weekday(now) + {j}, 7)]" for j in range(8)]
    dates[0], dates[7] = f"{dates[0]} & ~{past}", f"{dates[7]} & {past}"
    # as ``score`` has them: both prefer the hour, the coach, the member, neither
    levels = [(4, "cp & mp"), (3, "cp & ~mp"), (2, "mp & ~cp"), (1, "~(cp | mp)")]
    groups = ", ".join(f"named_struct('score', {points}, 'day', {j}, 'mask', {mask} & {level})"
                       for points, level in levels for j, mask in enumerate(dates))
    # the groups in which the first top_n hours lie, with the number of hours before each
    first = f"""aggregate(filter(array({groups}), g -> g.mask <> 0L),
        named_struct('n', 0, 'out', CAST(array() AS ARRAY<STRUCT<score: INT, day: INT, mask: BIGINT, before: INT>>)),
        (acc, g) -> named_struct(
            'n', acc.n + bit_count(g.mask),
            'out', IF(acc.n < {top_n}, concat(acc.out, array(named_struct('score', g.score, 'day', g.day, 'mask', g.mask,
                                                                          'before', acc.n))), acc.out)),
        acc -> acc.out)"""
    return (common.selectExpr("coach_id", "member_id", "now", f"explode({first}) AS g")
            .selectExpr("coach_id", "member_id", "date_add(to_date(now), g.day) AS date", "g", "explode(sequence(0, 23)) AS hour")
            .where("shiftright(g.mask, hour) & 1 = 1")
            .selectExpr("coach_id", "member_id", "date_format(date, 'yyyy-MM-dd') AS date", "date_format(date, 'EEEE') AS day", "hour",
                        "g.score AS preference_score", "g.before + bit_count(g.mask & (shiftleft(1L, hour + 1) - 1)) AS rank")
            .where(f"rank <= {top_n}"))


# ---------------------------------------------------------------- X3
def schedule_grid(pairs: DataFrame, free_days: DataFrame, prefs: DataFrame, sessions: DataFrame,
                  week_start) -> DataFrame:
    """The 7 x 24 grid for every coach-member pair for the week at ``week_start``.

    A person is one row (seven masks, the preferred hours, and a map from the cells that hold
    sessions to their number, at most 168 entries), so the joins see one row per pair; the
    cells are made behind them.
    """
    ws = lit_date(week_start)
    week = sessions.filter(F.col("session_date").between(ws, F.date_add(ws, 6)))
    cell = (F.weekday("session_date") * 24 + to_hour("session_time")).alias("cell")

    def person(kind: str) -> DataFrame:
        who = f"{kind}_id"
        held = (week.groupBy(F.col(who), cell).agg(F.count(F.lit(1)).alias("n")).filter("cell IS NOT NULL")
                .groupBy(who).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias(f"{kind}_held")))
        pref = _prefs_for(prefs, kind, who, "pref").select(who, hm.array_mask(F.col("pref")).alias(f"{kind}_pref"))
        open_ = _week_of(free_days, kind, who).withColumnRenamed("week", f"{kind}_week")
        return held.join(open_, who, "full").join(pref, who, "full")

    g = (pairs.select("coach_id", "member_id").distinct()
         .join(person("coach"), "coach_id", "left").join(person("member"), "member_id", "left")
         .withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
         .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    none = F.lit(0).cast("long")

    def held(kind: str) -> Column:
        return F.coalesce(F.try_element_at(f"{kind}_held", F.col("dow") * 24 + F.col("hour")), none)

    def open_at(kind: str) -> Column:
        return hm.has_hour(F.coalesce(F.get(f"{kind}_week", F.col("dow")), none), F.col("hour"))

    def likes(kind: str) -> Column:
        return hm.has_hour(F.coalesce(f"{kind}_pref", none), F.col("hour"))

    c_av, m_av = open_at("coach") & (held("coach") == 0), open_at("member") & (held("member") == 0)
    c_pr, m_pr = likes("coach"), likes("member")
    both = c_av & m_av
    day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("dow") + 1)
    return g.select("coach_id", "member_id", day.alias("day_of_week"), "hour",
                    c_av.alias("coach_available"), m_av.alias("member_available"),
                    c_pr.alias("coach_preferred"), m_pr.alias("member_preferred"),
                    held("coach").alias("coach_sessions"), held("member").alias("member_sessions"),
                    both.alias("available_for_both"),
                    F.when(both, score(c_pr, m_pr)).otherwise(0).alias("preference_score"))


# ---------------------------------------------------------------- J17 / A28 / X4
def weekly_spans(free_days: DataFrame, hours=GROUP_HOURS) -> DataFrame:
    """The hours ``lo`` to ``hi`` (inclusive, within ``hours``) that each row of the weekly pattern opens."""
    lo = F.greatest(F.coalesce(to_hour("start_time"), F.lit(8)), F.lit(hours[0]))
    hi = F.least(F.coalesce(to_hour("end_time"), F.lit(20)), F.lit(hours[1])) - 1
    return (free_days.filter("is_available")
            .select("user_id", "user_type", weekday_from_name("day_of_week").alias("dow"), lo.alias("lo"), hi.alias("hi"))
            .filter("lo <= hi"))


def _span_hours() -> Column:
    """One row per hour of a span."""
    # a sequence steps down where it ends before it starts
    return F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))).alias("hour")


def _overrides(slots: DataFrame, lo, hi, hours) -> DataFrame:
    """Date overrides in [lo, hi] x hours that say something."""
    return (slots.filter(F.col("slot_date").between(lit_date(lo), lit_date(hi))
                         & F.col("hour").between(hours[0], hours[1] - 1) & F.col("is_available").isNotNull())
            .select("user_id", "user_type", F.col("slot_date").alias("date"),
                    F.weekday("slot_date").alias("dow"), "hour", "is_available"))


def effective_availability(users: DataFrame, slots: DataFrame, free_days: DataFrame,
                           lo, hi, hours=GROUP_HOURS) -> DataFrame:
    """The (user, date, hour) cells in [lo, hi] x hours that are available: a date
    override wins over the weekly pattern; no information means unavailable.  Made from one
    mask per (user, date); only available hours become rows."""
    masks = hm.effective_masks(users, slots, free_days, lo, hi, hours)
    return masks.select("user_id", "user_type", "date", F.explode(hm.hours_of(F.col("free"))).alias("hour"))


def group_availability(member_coach: DataFrame, slots: DataFrame, free_days: DataFrame,
                       lo, hi, hours=GROUP_HOURS) -> DataFrame:
    """Members available per (coach, date, hour), 08-21 h.  The weekly pattern is
    counted per (coach, weekday, span of hours), and only the counted spans become hours; an
    override is compared with its member's week of masks, and only what it changes is added.
    Names stay in long form (``available_members``) rather than one collected list per cell.

    Each join has a side that grows with the members.  Its size is guessed from the compressed
    files, so without the hints Spark broadcasts it at any number of members."""
    bridge = member_coach.select("coach_id", F.col("member_id").alias("user_id")).hint("merge")
    of_members = free_days.filter(F.col("user_type") == "member")
    spans = weekly_spans(of_members, hours).filter("dow IS NOT NULL").select("user_id", "dow", "lo", "hi")
    weekly = (bridge.join(spans, "user_id").groupBy("coach_id", "dow", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
              .select("coach_id", "dow", _span_hours(), "n")
              .groupBy("coach_id", "dow", "hour").agg(F.sum("n").alias("n")))
    week = hm.weekly_pattern(of_members, hours).select("user_id", "week").hint("merge")
    is_open = hm.has_hour(F.coalesce(F.get("week", F.col("dow")), F.lit(0).cast("long")), F.col("hour"))
    changed = (_overrides(slots.filter(F.col("user_type") == "member"), lo, hi, hours)
               .join(week, "user_id", "left")
               .select("user_id", "date", "hour", (F.col("is_available").cast("int") - is_open.cast("int")).alias("d"))
               .filter("d != 0"))
    delta = bridge.join(changed, "user_id").groupBy("coach_id", "date", "hour").agg(F.sum("d").alias("d"))
    # a coach's grid: 7 x 13 cells a week, whatever the number of members
    grid = (bridge.groupBy("coach_id").agg(F.count(F.lit(1)).alias("members_considered"))
            .withColumn("date", F.explode(F.sequence(lit_date(lo), lit_date(hi))))
            .withColumn("dow", F.weekday("date"))
            .withColumn("hour", F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[1] - 1)))))
    return (grid.join(weekly, ["coach_id", "dow", "hour"], "left").join(delta, ["coach_id", "date", "hour"], "left")
            .select("coach_id", "date", "hour",
                    (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("available_count"),
                    "members_considered"))


def available_members(member_coach: DataFrame, members: DataFrame, slots: DataFrame,
                      free_days: DataFrame, lo, hi) -> DataFrame:
    """X4 detail: one row per (coach, date, hour, available member) with the name."""
    mem = member_coach.select(F.col("member_id").alias("user_id")).distinct() \
        .withColumn("user_type", F.lit("member"))
    av = effective_availability(mem, slots, free_days, lo, hi)
    return (member_coach.select("coach_id", F.col("member_id").alias("user_id")).join(av, "user_id")
            .join(members.select(F.col("id").alias("user_id"), "name"), "user_id")
            .select("coach_id", "date", "hour", F.col("user_id").alias("member_id"), "name"))


# ---------------------------------------------------------------- X5 / X40 / A24
def month_calendar(users: DataFrame, slots: DataFrame, year: int, month: int) -> DataFrame:
    """Every day of the month for every user with its hour -> available map."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    days = (users.select("user_id", "user_type")
            .withColumn("date", F.explode(F.sequence(first, F.last_day(first)))))
    per_day = (slots.filter(F.col("slot_date").between(first, F.last_day(first)))
               # a slot that is stored twice counts once: available if one of its rows says so
               .groupBy("user_id", "user_type", F.col("slot_date").alias("date"), "hour")
               .agg(F.max("is_available").alias("is_available"))
               .groupBy("user_id", "user_type", "date")
               .agg(F.map_from_entries(F.array_sort(F.collect_list(
                   F.struct("hour", "is_available")))).alias("slots")))
    return (days.join(per_day, ["user_id", "user_type", "date"], "left")
            .select("user_id", "user_type", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    F.date_format("date", "EEEE").alias("day_of_week"),
                    F.dayofmonth("date").alias("day_number"),
                    F.coalesce("slots", F.create_map().cast("map<int,boolean>")).alias("slots")))


def availability_map(slots: DataFrame, lo=None, hi=None) -> DataFrame:
    """Per (user, date): hours available and hours blocked (bounded by 24)."""
    s = slots
    if lo is not None and hi is not None:
        s = s.filter(F.col("slot_date").between(lit_date(lo), lit_date(hi)))
    return s.groupBy("user_id", "user_type", "slot_date").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_available"), F.col("hour")))).alias("available_hours"),
        F.array_sort(F.collect_list(F.when(~F.col("is_available"), F.col("hour")))).alias("blocked_hours"))


def sessions_by_slot(sessions: DataFrame, who: str) -> DataFrame:
    """Sessions of one week grouped per (person, weekday_hour) as nested records (P16),
    in time order; bounded by the sessions of one person's hour."""
    entry = F.struct("schedule.session_date", "schedule.session_time", "id", "member", "schedule", "workout")
    slot = F.concat(F.date_format("schedule.session_date", "EEEE"), F.lit("_"),
                    to_hour("schedule.session_time").cast("string"))
    return (to_nested_session(sessions, keep=[who])
            .groupBy(who, slot.alias("slot"))
            .agg(F.array_sort(F.collect_list(entry)).alias("sessions")))


# ---------------------------------------------------------------- X11
# Why a range request (or an hour of it) writes no slot.
RANGE_REASONS = {"missing": "Missing date or hour", "inverted": "Range ends before it starts",
                 "hours": "Hour outside 0-23"}


def bulk_range_reason() -> F.Column:
    """X11: the reason why a range request is refused as a whole, NULL if it is not."""
    bounds = ("start_date", "end_date", "start_hour", "end_hour")
    missing = F.lit(False)
    for c in bounds:
        missing = missing | F.col(c).isNull()
    return (F.when(missing, F.lit(RANGE_REASONS["missing"]))
            .when((F.col("start_date") > F.col("end_date")) | (F.col("start_hour") > F.col("end_hour")),
                  F.lit(RANGE_REASONS["inverted"]))
            .when((F.col("start_hour") < 0) | (F.col("end_hour") > 23), F.lit(RANGE_REASONS["hours"])))


def rejected_bulk_requests(requests: DataFrame) -> DataFrame:
    """X11: the range requests that write no slot, with their ``reason``."""
    return requests.withColumn("reason", bulk_range_reason()).filter(F.col("reason").isNotNull())


def bulk_requests_to_slots(requests: DataFrame) -> DataFrame:
    """X11: a (dates x hours, inclusive) range request -> one slot row per date and hour.
    Refused requests are in ``rejected_bulk_requests``."""
    r = requests.filter(bulk_range_reason().isNull())
    # a sequence steps down where it ends before it starts: the case guards it also when
    # the filter is evaluated later
    dates = F.when(F.col("start_date") <= F.col("end_date"), F.sequence("start_date", "end_date"))
    hours = F.when(F.col("start_hour") <= F.col("end_hour"), F.sequence("start_hour", "end_hour"))
    return (r.withColumn("slot_date", F.explode(dates)).withColumn("hour", F.explode(hours))
            .select("user_id", "user_type", "slot_date", "hour", "is_available", "seq"))


# ---------------------------------------------------------------- blocked hours
def blocked_hours(sessions: DataFrame) -> DataFrame:
    """the (weekday, hour) cells a session blocks: ``max(1, ceil(duration/60))`` hours."""
    st = start_ts("session_date", "session_time")
    return (sessions.select("id", "coach_id", "member_id", st.alias("st"),
                            F.explode(F.sequence(F.lit(0), hours_to_block("duration") - 1)).alias("i"))
            .withColumn("blocked", F.timestamp_add("HOUR", F.col("i"), F.col("st")))
            .select("id", "coach_id", "member_id",
                    F.date_format("blocked", "EEEE").alias("day_of_week"),
                    F.hour("blocked").alias("hour")))
