"""A1-A14, W1-W5 and the join shapes J1-J9, J23-J24: session and membership reporting.

Design rules used throughout:

* Facts are aggregated *before* they meet a dimension or a bridge table
  (J8), so a join never multiplies fact rows.  Aggregations run partial
  (map-side) then final, so a hot coach or member is combined on every map task
  before the shuffle.
* Distinct counts are two-level: group by (entity, item) first -- this spreads
  a hot entity across partitions by the second key -- then count per entity.
* Dimension tables (coaches, members, gyms) join last; AQE decides broadcast by
  their measured runtime size (``autoBroadcastJoinThreshold``), never by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.notes import parse_notes_sql
from gymlake.functions.rates import performance_rating, rate, rate_or_zero
from gymlake.functions.timeutil import lit_date
from gymlake.operators.filters import range_start

# Membership prices per month.  The reference uses VIP 150 in
# revenue reports and VIP 200 in billing (D3); callers choose.
REVENUE_PRICES = {"Basic": 50.0, "Premium": 100.0, "VIP": 150.0}
BILLING_PRICES = {"Basic": 50.0, "Premium": 100.0, "VIP": 200.0}
DEFAULT_WORKOUT = "No data"


def _status_is(value: str) -> Column:
    return F.lower(F.col("status")) == value.lower()


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def tier_price(tier, prices: dict) -> Column:
    """Tier price lookup compiled into a ``CASE`` (no join); unknown tiers give NULL."""
    tier = F.col(tier) if isinstance(tier, str) else tier
    out = None
    for k, v in prices.items():
        out = (F.when if out is None else out.when)(tier == F.lit(k), F.lit(float(v)))
    return out.cast("double")


# ---------------------------------------------------------------- A1 / A8
def session_stats(sessions: DataFrame, by, as_of) -> DataFrame:
    """A1: total / completed / cancelled / upcoming / week / week-completed per key."""
    by = [by] if isinstance(by, str) else list(by)
    d = lit_date(as_of)
    week = F.col("session_date") >= F.date_sub(d, 7)
    return (sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(_flag(_status_is("Completed"))).alias("completed_sessions"),
        F.sum(_flag(_status_is("Cancelled"))).alias("cancelled_sessions"),
        F.sum(_flag(F.col("session_date") >= d)).alias("upcoming_sessions"),
        F.sum(_flag(week)).alias("week_sessions"),
        F.sum(_flag(week & _status_is("Completed"))).alias("week_completed_sessions"),
    ).withColumn("week_progress",
                 rate_or_zero("week_completed_sessions", "week_sessions", 0).cast("int")))


def _member_session_agg(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(_flag(_status_is("Completed"))).alias("completed_sessions"),
        F.sum(_flag(_status_is("Cancelled"))).alias("cancelled_sessions"),
        F.max(F.when(_status_is("Completed"), F.col("session_date"))).alias("last_session"),
    )


# ---------------------------------------------------------------- A2
def member_overview(members: DataFrame, member_coach: DataFrame, sessions: DataFrame) -> DataFrame:
    """A2: per (coach, assigned member): sessions, completed, cancelled, last completed
    session and attendance rate.  Sessions are pre-aggregated per member first."""
    per_member = _member_session_agg(sessions)
    return (member_coach.select("coach_id", "member_id")
            .join(members.select(F.col("id").alias("member_id"), "name", "email",
                                 "membership_type", "gym_id"), "member_id")
            .join(per_member, "member_id", "left")
            .select("coach_id", "member_id", "name", "email", "membership_type", "gym_id",
                    F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                    F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"),
                    F.coalesce("cancelled_sessions", F.lit(0)).alias("cancelled_sessions"),
                    "last_session")
            .withColumn("attendance_rate",
                        rate_or_zero("completed_sessions", "total_sessions", 1)))


# ---------------------------------------------------------------- A3
def coach_overview(coaches: DataFrame, member_coach: DataFrame, sessions: DataFrame) -> DataFrame:
    """Members, sessions, completed and completion rate per coach.

    The reference joins coach x bridge x sessions and hides the fan-out with
    COUNT(DISTINCT); here each side is aggregated on its own, then joined (D2).
    """
    members = member_coach.groupBy("coach_id").agg(
        F.count_distinct("member_id").alias("total_members"))
    sess = sessions.groupBy("coach_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(_flag(_status_is("Completed"))).alias("completed_sessions"))
    return (coaches.select(F.col("id").alias("coach_id"), "gym_id", "name", "email",
                           "specialization", "status")
            .join(members, "coach_id", "left")
            .join(sess, "coach_id", "left")
            .select("coach_id", "gym_id", "name", "email", "specialization", "status",
                    F.coalesce("total_members", F.lit(0)).alias("total_members"),
                    F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                    F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"))
            .withColumn("completion_rate",
                        rate_or_zero("completed_sessions", "total_sessions", 1)))


# ---------------------------------------------------------------- A4 / A9
def coach_dashboard(coaches: DataFrame, member_coach: DataFrame, sessions: DataFrame,
                    as_of) -> DataFrame:
    """A4: the coach dashboard counters for every coach, with the A9 rating."""
    members = member_coach.groupBy("coach_id").agg(
        F.count_distinct("member_id").alias("total_members"))
    stats = session_stats(sessions, "coach_id", as_of).drop("cancelled_sessions", "week_progress")
    out = (coaches.select(F.col("id").alias("coach_id"), "gym_id", "name")
           .join(members, "coach_id", "left").join(stats, "coach_id", "left"))
    counters = ["total_members", "total_sessions", "completed_sessions", "upcoming_sessions",
                "week_sessions", "week_completed_sessions"]
    out = out.select("coach_id", "gym_id", "name",
                     *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])
    return out.withColumn(
        "performance_rating",
        performance_rating(rate("completed_sessions", "total_sessions", 6)))


# ---------------------------------------------------------------- A6 / A7 / A13
def gym_dashboard(gyms: DataFrame, members: DataFrame, coaches: DataFrame,
                  sessions: DataFrame, as_of, prices: dict | None = None) -> DataFrame:
    """The four scalar subqueries of the gym dashboard, for every gym in one pass."""
    prices = prices or REVENUE_PRICES
    mem = (members.withColumn("price", tier_price("membership_type", prices))
           .groupBy("gym_id").agg(F.count(F.lit(1)).alias("total_members"),
                                  F.sum("price").alias("monthly_revenue")))
    coa = (coaches.filter(F.col("status") == "Active").groupBy("gym_id")
           .agg(F.count(F.lit(1)).alias("active_coaches")))
    ses = (sessions.filter(F.col("session_date") == lit_date(as_of)).groupBy("gym_id")
           .agg(F.count(F.lit(1)).alias("today_sessions")))
    return (gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name"))
            .join(mem, "gym_id", "left").join(coa, "gym_id", "left").join(ses, "gym_id", "left")
            .select("gym_id", "gym_name",
                    F.coalesce("total_members", F.lit(0)).alias("total_members"),
                    F.coalesce("active_coaches", F.lit(0)).alias("active_coaches"),
                    F.coalesce("today_sessions", F.lit(0)).alias("today_sessions"),
                    F.round(F.coalesce("monthly_revenue", F.lit(0.0)), 2).alias("monthly_revenue")))


def monthly_revenue(members: DataFrame, prices: dict | None = None) -> DataFrame:
    """Revenue by gym and tier with per-gym totals (``rollup``); tier NULL = gym total."""
    prices = prices or REVENUE_PRICES
    priced = members.withColumn("price", tier_price("membership_type", prices))
    return (priced.rollup("gym_id", "membership_type")
            .agg(F.count(F.lit(1)).alias("members"),
                 F.round(F.coalesce(F.sum("price"), F.lit(0.0)), 2).alias("revenue"))
            .filter(F.col("gym_id").isNotNull()))


def membership_stats(members: DataFrame, as_of) -> DataFrame:
    """Membership mix per gym and joiners in the 30 days to ``as_of``."""
    lo = F.date_sub(lit_date(as_of), 30)
    return members.groupBy("gym_id", "membership_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(_flag(F.col("join_date") >= lo)).alias("new_members"))


def revenue_stats(members: DataFrame, prices: dict | None = None) -> DataFrame:
    """X28 part 3: revenue and tier head counts per gym."""
    prices = prices or REVENUE_PRICES
    priced = members.withColumn("price", tier_price("membership_type", prices))
    return priced.groupBy("gym_id").agg(
        F.round(F.sum("price"), 2).alias("monthly_revenue"),
        F.count(F.when(F.col("membership_type") == "Basic", 1)).alias("basic_members"),
        F.count(F.when(F.col("membership_type") == "Premium", 1)).alias("premium_members"),
        F.count(F.when(F.col("membership_type") == "VIP", 1)).alias("vip_members"))


# ---------------------------------------------------------------- A14
def coach_analytics(coaches: DataFrame, sessions: DataFrame) -> DataFrame:
    """A14 (all time): sessions, completed, distinct members and completion rate
    (2 dp, half-up, NULL without sessions) for every coach, busiest first."""
    per = (sessions.groupBy("coach_id", "member_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(_flag(_status_is("Completed"))).alias("done"))
           .groupBy("coach_id")
           .agg(F.sum("n").alias("total_sessions"), F.sum("done").alias("completed_sessions"),
                F.count("member_id").alias("unique_members")))
    return (coaches.select(F.col("id").alias("coach_id"), "gym_id",
                           F.col("name").alias("coach_name"), F.col("email").alias("coach_email"),
                           "specialization")
            .join(per, "coach_id", "left")
            .select("gym_id", "coach_id", "coach_name", "coach_email", "specialization",
                    F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                    F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"),
                    F.coalesce("unique_members", F.lit(0)).alias("unique_members"))
            .withColumn("completion_rate",
                        rate("completed_sessions", "total_sessions", 2, "half_up"))
            .orderBy(F.desc("total_sessions"), "coach_id"))


def gym_session_report(sessions: DataFrame, as_of, days: int = 30) -> DataFrame:
    """30-day session counters per gym."""
    recent = sessions.filter(F.col("session_date") >= F.date_sub(lit_date(as_of), days))
    # one pass over the sessions; the distinct counts run on its (gym, coach, member) rows
    per = recent.groupBy("gym_id", "coach_id", "member_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_flag(_status_is("Completed"))).alias("done"),
        F.sum(_flag(_status_is("Cancelled"))).alias("off"))
    return per.groupBy("gym_id").agg(
        F.sum("n").alias("total_sessions"), F.sum("done").alias("completed_sessions"),
        F.sum("off").alias("cancelled_sessions"), F.count_distinct("member_id").alias("active_members"),
        F.count_distinct("coach_id").alias("active_coaches"))


def coach_performance(coaches: DataFrame, sessions: DataFrame, as_of, days: int = 30) -> DataFrame:
    """30-day coach performance.  The range predicate sits in the join (D4),
    so coaches with only older sessions are kept with zeros."""
    recent = sessions.filter(F.col("session_date") >= F.date_sub(lit_date(as_of), days))
    per = (recent.groupBy("coach_id", "member_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(_flag(_status_is("Completed"))).alias("done"))
           .groupBy("coach_id")
           .agg(F.sum("n").alias("total_sessions"), F.sum("done").alias("completed_sessions"),
                F.count("member_id").alias("unique_members")))
    return (coaches.select(F.col("id").alias("coach_id"), "gym_id", F.col("name").alias("coach_name"))
            .join(per, "coach_id", "left")
            .select("gym_id", "coach_id", "coach_name",
                    *[F.coalesce(c, F.lit(0)).alias(c)
                      for c in ("total_sessions", "completed_sessions", "unique_members")]))


# ---------------------------------------------------------------- A10-A12 (coach progress)
def _coach_scope(per_member: DataFrame, member_coach: DataFrame, keys, sums) -> DataFrame:
    """Roll member-level aggregates up to every coach the member is assigned to (the
    reference's bridge join).  Sessions are aggregated per member *before* the
    bridge, so the join sees one row per (member, key) instead of every session,
    and a member holding a third of all sessions contributes a handful of rows."""
    bridge = member_coach.select("member_id", "coach_id")
    return (per_member.join(bridge, "member_id")
            .groupBy("coach_id", *keys).agg(*[F.sum(c).alias(c) for c in sums]))


def _scoped(sessions: DataFrame, time_range: str, as_of) -> DataFrame:
    lo = range_start(time_range, as_of)
    return sessions if lo is None else sessions.filter(F.col("session_date") >= lo)


def workout_distribution(sessions: DataFrame, member_coach: DataFrame, time_range: str = "all",
                         as_of=None) -> DataFrame:
    """Sessions per parsed workout type per coach (notes with a type marker only)."""
    s = _scoped(sessions, time_range, as_of).filter(F.col("notes").ilike("%Workout Type:%"))
    per = (s.groupBy("member_id", parse_notes_sql("notes").getField("workout_type").alias("workout_type"))
           .agg(F.count(F.lit(1)).alias("count")))
    return _coach_scope(per, member_coach, ["workout_type"], ["count"])


def common_workout(distribution: DataFrame) -> DataFrame:
    """A10: the most frequent type per coach, derived from A11 (one scan, not two);
    ties broken by type name.  The window holds one row per (coach, type)."""
    w = Window.partitionBy("coach_id").orderBy(F.desc("count"), "workout_type")
    return (distribution.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def session_history(sessions: DataFrame, member_coach: DataFrame, time_range: str = "all",
                    as_of=None) -> DataFrame:
    """Sessions per day per coach."""
    per = (_scoped(sessions, time_range, as_of).groupBy("member_id", "session_date")
           .agg(F.count(F.lit(1)).alias("count")))
    return (_coach_scope(per, member_coach, ["session_date"], ["count"])
            .withColumn("date", F.date_format("session_date", "yyyy-MM-dd")))


def coach_progress_stats(sessions: DataFrame, member_coach: DataFrame, time_range: str,
                         as_of) -> DataFrame:
    """A1 + A8 for X25: counters and attendance rate (0 dp, half-even) per coach."""
    per = _scoped(sessions, time_range, as_of).groupBy("member_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(_flag(_status_is("Completed"))).alias("completed_sessions"),
        F.sum(_flag(_status_is("Cancelled"))).alias("cancelled_sessions"))
    return (_coach_scope(per, member_coach, [],
                         ["total_sessions", "completed_sessions", "cancelled_sessions"])
            .withColumn("attendance_rate",
                        rate_or_zero("completed_sessions", "total_sessions", 0).cast("int")))


def coach_progress_counts(sessions: DataFrame, member_coach: DataFrame, time_range: str,
                          as_of) -> DataFrame:
    """A1 + A8 and A12 for X25 in one pipeline: per-(member, day) partial counts
    cross the bridge once, are summed per (coach, day), and one per-coach aggregate
    yields the counters, the attendance rate and the number of active days."""
    cols = ["total_sessions", "completed_sessions", "cancelled_sessions"]
    per_day = _scoped(sessions, time_range, as_of).groupBy("member_id", "session_date").agg(
        F.count(F.lit(1)).alias(cols[0]),
        F.sum(_flag(_status_is("Completed"))).alias(cols[1]),
        F.sum(_flag(_status_is("Cancelled"))).alias(cols[2]))
    return (_coach_scope(per_day, member_coach, ["session_date"], cols)
            .groupBy("coach_id").agg(*[F.sum(c).alias(c) for c in cols],
                                     F.count(F.lit(1)).alias("active_days"))
            .withColumn("attendance_rate",
                        rate_or_zero("completed_sessions", "total_sessions", 0).cast("int")))


def member_counters_and_streaks(sessions: DataFrame, as_of) -> DataFrame:
    """A1 + A8 + W1 for X27 in one pipeline over one scan.

    Sessions are counted per (member, day); a running count of completed days per
    member (window bounded by the calendar) gives each completed day its
    gaps-and-islands group ``day - running count``; one aggregate per (member,
    group) and one per member then yield the counters and both streaks.  A day
    without a completed session never joins a run, exactly as in ``streaks``."""
    d = lit_date(as_of)
    week = F.col("session_date") >= F.date_sub(d, 7)
    per_day = sessions.groupBy("member_id", "session_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_flag(_status_is("Completed"))).alias("done"),
        F.sum(_flag(_status_is("Cancelled"))).alias("cancelled"))
    streak_day = (F.col("done") > 0) & (F.col("session_date") <= d)
    w = (Window.partitionBy("member_id").orderBy("session_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (per_day.withColumn("_sd", streak_day)
            .withColumn("_grp", F.date_sub("session_date", F.sum(_flag(F.col("_sd"))).over(w).cast("int")))
            .groupBy("member_id", "_grp").agg(
                F.sum("n").alias("n"), F.sum("done").alias("done"), F.sum("cancelled").alias("cancelled"),
                F.sum(F.when(F.col("session_date") >= d, F.col("n")).otherwise(0)).alias("upcoming"),
                F.sum(F.when(week, F.col("n")).otherwise(0)).alias("wk"),
                F.sum(F.when(week, F.col("done")).otherwise(0)).alias("wk_done"),
                F.count(F.when(F.col("_sd"), 1)).alias("run_len"),
                F.max(F.when(F.col("_sd"), F.col("session_date"))).alias("run_end")))
    return (runs.groupBy("member_id").agg(
                F.sum("n").alias("total_sessions"), F.sum("done").alias("completed_sessions"),
                F.sum("cancelled").alias("cancelled_sessions"), F.sum("upcoming").alias("upcoming_sessions"),
                F.sum("wk").alias("week_sessions"), F.sum("wk_done").alias("week_completed_sessions"),
                F.coalesce(F.max(F.when(F.col("run_len") > 0, F.col("run_len"))), F.lit(0)).alias("longest_streak"),
                F.coalesce(F.max(F.when(F.col("run_end") >= F.date_sub(d, 1), F.col("run_len"))),
                           F.lit(0)).alias("current_streak"))
            .withColumn("week_progress",
                        rate_or_zero("week_completed_sessions", "week_sessions", 0).cast("int")))


# ---------------------------------------------------------------- W1
def streaks(sessions: DataFrame, as_of) -> DataFrame:
    """Current and longest run of consecutive days with a completed session.

    Gaps-and-islands on *distinct* days, ascending (D1): ``day - row_number`` is
    constant inside a run.  The current streak is the run ending on ``as_of`` or
    the day before, else 0.  The window is per member over distinct days, so its
    size is bounded by the calendar, not by the member's session count.
    """
    d = lit_date(as_of)
    days = (sessions.filter(_status_is("Completed") & (F.col("session_date") <= d))
            .select("member_id", "session_date").distinct())
    w = Window.partitionBy("member_id").orderBy("session_date")
    runs = (days.withColumn("_grp", F.date_sub("session_date", F.row_number().over(w)))
            .groupBy("member_id", "_grp")
            .agg(F.count(F.lit(1)).alias("run_len"), F.max("session_date").alias("run_end")))
    return runs.groupBy("member_id").agg(
        F.max("run_len").alias("longest_streak"),
        F.coalesce(F.max(F.when(F.col("run_end") >= F.date_sub(d, 1), F.col("run_len"))),
                   F.lit(0)).alias("current_streak"),
        F.sum("run_len").alias("active_days"))


# ---------------------------------------------------------------- W2 / W3 / W5
def latest_n(df: DataFrame, by, order, n: int) -> DataFrame:
    """The first ``n`` rows per key under ``order`` (list of Columns, already
    directed; include a unique tie-break).  Catalyst plans a WindowGroupLimit, so
    each map task keeps only ``n`` rows per key before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(
        F.col("rank_in_group") <= n)


def first_by(df: DataFrame, by, order) -> DataFrame:
    """One row per key where the reference does ``fetchone()``."""
    return latest_n(df, by, order, 1).drop("rank_in_group")


# ---------------------------------------------------------------- joins J1-J4, J7, J9, J23, J24
def sessions_with_member(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """J1."""
    return sessions.join(members.select(F.col("id").alias("member_id"),
                                        F.col("name").alias("member_name"),
                                        F.col("email").alias("member_email")), "member_id")


def gym_sessions(sessions: DataFrame, members: DataFrame, coaches: DataFrame) -> DataFrame:
    """Sessions with member and coach names."""
    return (sessions_with_member(sessions, members)
            .join(coaches.select(F.col("id").alias("coach_id"),
                                 F.col("name").alias("coach_name")), "coach_id"))


def member_session_history(sessions: DataFrame, coaches: DataFrame, gyms: DataFrame) -> DataFrame:
    """Sessions with coach and gym."""
    return (sessions.join(coaches.select(F.col("id").alias("coach_id"),
                                         F.col("name").alias("coach_name")), "coach_id")
            .join(gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name")),
                  "gym_id"))


def coach_members(member_coach: DataFrame, members: DataFrame) -> DataFrame:
    """Members of every coach with the assignment date."""
    return member_coach.join(members.withColumnRenamed("id", "member_id"), "member_id")


def restrict_to_coach(df: DataFrame, member_coach: DataFrame, coach_col: str = "coach_id",
                      member_col: str = "member_id") -> DataFrame:
    """Keep rows whose (coach, member) pair is an assignment (semi join)."""
    pairs = member_coach.select(F.col("coach_id").alias(coach_col),
                                F.col("member_id").alias(member_col))
    return df.join(pairs, [coach_col, member_col], "left_semi")


def coach_profile(coaches: DataFrame, gyms: DataFrame) -> DataFrame:
    """J23."""
    return coaches.join(gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name")),
                        "gym_id")
