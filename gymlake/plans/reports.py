"""Report bundles and exports composed from the operators.

A bundle returns several DataFrames (one Spark job each when written); the
``*_summary`` forms join per-entity aggregates on the entity key into one row
per gym/coach/member.  Exports are the reference's 15 spreadsheet reports,
re-aimed to cover every entity at once (keyed by its id) and written through
``sources.sinks.write_report``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.notes import parse_notes_sql, parse_notes_strict
from gymlake.functions.rates import rate_or_zero
from gymlake.functions.text import coalesce_food_name
from gymlake.functions.timeutil import WEEKDAYS, lit_date
from gymlake.operators import attendance as at
from gymlake.operators.ordering import weekday_order
from gymlake.sources.json_docs import DEFAULT_WEEK, with_default_preferences
from gymlake.sources.tables import Tables

DASHBOARD_EXPORT_ROWS = 50  # fixed value: sessions of a dashboard export


# ---------------------------------------------------------------- X28
def gym_report_summary(t: Tables, as_of) -> DataFrame:
    """X28 as one row per gym: membership, 30-day sessions, revenue and rates."""
    # membership mix (A13) and revenue (A7) in one aggregate over the members
    lo = F.date_sub(lit_date(as_of), 30)
    tier = F.col("membership_type")
    mem = (t.members.withColumn("price", at.tier_price("membership_type", at.REVENUE_PRICES))
           .groupBy("gym_id")
           .agg(F.count(F.lit(1)).alias("total_members"),
                F.count(F.when(F.col("join_date") >= lo, 1)).alias("new_members"),
                F.round(F.sum("price"), 2).alias("monthly_revenue"),
                *[F.count(F.when(tier == k, 1)).alias(f"{k.lower()}_members")
                  for k in ("Basic", "Premium", "VIP")]))
    ses = at.gym_session_report(t.sessions, as_of)
    g = t.gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name"))
    out = g.join(mem, "gym_id", "left").join(ses, "gym_id", "left")
    zero = ["total_members", "new_members", "total_sessions", "completed_sessions",
            "cancelled_sessions", "active_members", "active_coaches", "basic_members",
            "premium_members", "vip_members"]
    out = out.select("gym_id", "gym_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
                     F.coalesce("monthly_revenue", F.lit(0.0)).alias("monthly_revenue"))
    return out.withColumn("completion_rate", F.round(rate_or_zero("completed_sessions", "total_sessions", 6), 1))


# ---------------------------------------------------------------- X27
def member_dashboard(t: Tables, as_of) -> DataFrame:
    """Counters (A1), week progress (A8), streaks (W1) and coach (J4) per member."""
    stats = at.member_counters_and_streaks(t.sessions, as_of)
    coach = (t.member_coach.groupBy("member_id").agg(F.min("coach_id").alias("coach_id"))
             .join(t.coaches.select(F.col("id").alias("coach_id"), F.col("name").alias("coach_name")),
                   "coach_id", "left"))
    m = t.members.select(F.col("id").alias("member_id"), "name", "membership_type")
    out = m.join(stats, "member_id", "left").join(coach, "member_id", "left")
    counters = ["total_sessions", "completed_sessions", "cancelled_sessions", "upcoming_sessions",
                "week_sessions", "week_completed_sessions", "week_progress", "current_streak",
                "longest_streak"]
    return out.select("member_id", "name", "membership_type", "coach_id", "coach_name",
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])


# ---------------------------------------------------------------- X25 / X26
def coach_progress(t: Tables, time_range: str, as_of) -> DataFrame:
    """Per coach: counters and attendance (A1/A8), most common workout (A10),
    number of types (A11) and active days (A12) over the coach's members' sessions."""
    stats = at.coach_progress_counts(t.sessions, t.member_coach, time_range, as_of)
    dist = at.workout_distribution(t.sessions, t.member_coach, time_range, as_of)
    common = at.common_workout(dist).select("coach_id", F.col("workout_type").alias("common_workout"))
    types = dist.groupBy("coach_id").agg(F.count(F.lit(1)).alias("workout_types"))
    c = t.coaches.select(F.col("id").alias("coach_id"), "name")
    out = (c.join(stats, "coach_id", "left").join(common, "coach_id", "left")
           .join(types, "coach_id", "left"))
    zero = ["total_sessions", "completed_sessions", "cancelled_sessions", "attendance_rate",
            "workout_types", "active_days"]
    return out.select("coach_id", "name", *[F.coalesce(x, F.lit(0)).alias(x) for x in zero],
                      F.coalesce("common_workout", F.lit(at.DEFAULT_WORKOUT)).alias("common_workout"))


def member_progress(t: Tables, as_of) -> DataFrame:
    """Per member: counters, attendance (0 dp), most common workout type."""
    s = t.sessions
    stats = s.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(F.when(F.lower("status") == "completed", 1).otherwise(0)).alias("completed_sessions"))
    typed = (s.filter(F.col("notes").ilike("%Workout Type:%"))
             .groupBy("member_id", parse_notes_sql("notes").workout_type.alias("workout_type"))
             .agg(F.count(F.lit(1)).alias("count")).withColumnRenamed("member_id", "coach_id"))
    common = (at.common_workout(typed).select(F.col("coach_id").alias("member_id"),
                                              F.col("workout_type").alias("common_workout")))
    m = t.members.select(F.col("id").alias("member_id"), "name")
    out = m.join(stats, "member_id").join(common, "member_id", "left")
    return out.select("member_id", "name", "total_sessions", "completed_sessions",
                      rate_or_zero("completed_sessions", "total_sessions", 0).cast("int").alias("attendance_rate"),
                      F.coalesce("common_workout", F.lit(at.DEFAULT_WORKOUT)).alias("common_workout"))


# ---------------------------------------------------------------- X35
def member_detail(t: Tables, n: int = 10) -> DataFrame:
    """The last ``n`` sessions of each assigned member with that coach (F1 parsed)."""
    s = at.restrict_to_coach(t.sessions, t.member_coach)
    latest = at.latest_n(s, ["coach_id", "member_id"],
                         [F.desc("session_date"), F.desc("session_time"), F.desc("id")], n)
    p = parse_notes_strict("notes")
    return latest.select("coach_id", "member_id", "id", "session_date", "session_time", "status",
                         p.workout_type.alias("workout_type"),
                         F.array_join(p.exercises, "|").alias("exercises"), "rank_in_group")


# ---------------------------------------------------------------- X39
def sessions_by_day(t: Tables, lo, hi) -> DataFrame:
    """Sessions per gym and day over [lo, hi]; days without sessions are kept."""
    spine = t.gyms.select(F.col("id").alias("gym_id"),
                          F.explode(F.sequence(lit_date(lo), lit_date(hi))).alias("session_date"))
    per = (t.sessions.filter(F.col("session_date").between(lit_date(lo), lit_date(hi)))
           .groupBy("gym_id", "session_date")
           .agg(F.count(F.lit(1)).alias("sessions"), F.min("session_time").alias("first_time"),
                F.max("session_time").alias("last_time")))
    return (spine.join(per, ["gym_id", "session_date"], "left")
            .select("gym_id", "session_date", F.coalesce("sessions", F.lit(0)).alias("sessions"),
                    "first_time", "last_time"))


def day_schedule(t: Tables, lo, hi) -> DataFrame:
    """The sessions of every gym and day over [lo, hi] in time order, with member and coach;
    a day without sessions is one row without a session (``place`` 0)."""
    spine = t.gyms.select(F.col("id").alias("gym_id"),
                          F.explode(F.sequence(lit_date(lo), lit_date(hi))).alias("session_date"))
    rows = (t.sessions.filter(F.col("session_date").between(lit_date(lo), lit_date(hi)))
            .select("gym_id", "session_date", F.col("id").alias("session_id"), "session_time", "status", "member_id", "coach_id")
            .join(t.members.select(F.col("id").alias("member_id"), F.col("name").alias("member_name")), "member_id", "left")
            .join(t.coaches.select(F.col("id").alias("coach_id"), F.col("name").alias("coach_name")), "coach_id", "left"))
    in_day = Window.partitionBy("gym_id", "session_date").orderBy("session_time", "session_id")
    return (spine.join(rows, ["gym_id", "session_date"], "left")
            .select("gym_id", "session_date", F.when(F.col("session_id").isNull(), 0).otherwise(F.row_number().over(in_day)).alias("place"),
                    "session_id", "session_time", "status", "member_name", "coach_name"))


# ---------------------------------------------------------------- X34 / X33
def weekly_text(free_days: DataFrame) -> DataFrame:
    """Each user's week as one ordered text (Monday first); at most 7 entries per user."""
    entry = F.concat_ws(" ", F.col("day_of_week"),
                        F.when(F.col("is_available"), F.concat(F.col("start_time"), F.lit("-"),
                                                                F.col("end_time")))
                        .otherwise(F.lit("off")))
    return (free_days.groupBy("user_id", "user_type")
            .agg(F.array_sort(F.collect_list(F.struct(weekday_order("day_of_week").alias("o"),
                                                      entry.alias("e")))).alias("_w"))
            .select("user_id", "user_type", F.array_join(F.transform("_w", lambda x: x["e"]), "; ")
                    .alias("week")))


def default_week_text() -> str:
    d = DEFAULT_WEEK
    return "; ".join(f"{w} {d['start_time']}-{d['end_time']}" for w in WEEKDAYS)


def user_profile(t: Tables) -> DataFrame:
    """Preferences (with defaults) and the weekly availability of every user."""
    users = t.all_users.select(F.col("id").alias("user_id"), "user_type", "name")
    prefs = with_default_preferences(users, t.user_preferences)
    week = weekly_text(t.free_days)
    return (users.join(prefs, ["user_id", "user_type"], "left").join(week, ["user_id", "user_type"], "left")
            .select("user_id", "user_type", "name", "preferred_duration",
                    F.array_join("preferred_time_slots", ",").alias("preferred_time_slots"),
                    F.array_join("preferred_workout_types", ",").alias("preferred_workout_types"),
                    F.coalesce("week", F.lit(default_week_text())).alias("week")))


def coach_schedule(t: Tables, lo, hi) -> DataFrame:
    """Each coach's sessions in [lo, hi] with member name, parsed type and the
    coach's weekly availability attached."""
    s = t.sessions.filter(F.col("session_date").between(lit_date(lo), lit_date(hi)))
    j = at.sessions_with_member(s, t.members)
    week = (weekly_text(t.free_days).filter(F.col("user_type") == "coach")
            .select(F.col("user_id").alias("coach_id"), "week"))
    p = parse_notes_strict("notes")
    return (j.join(week, "coach_id", "left")
            .select("coach_id", "id", "member_id", "member_name", "session_date", "session_time",
                    "duration", "status", p.workout_type.alias("workout_type"),
                    F.coalesce("week", F.lit(default_week_text())).alias("coach_week")))


def member_schedule(t: Tables, lo, hi) -> DataFrame:
    """Each member's sessions in [lo, hi] with the coach, the parsed type and the
    coach's weekly availability."""
    s = t.sessions.filter(F.col("session_date").between(lit_date(lo), lit_date(hi)))
    c = t.coaches.select(F.col("id").alias("coach_id"), F.col("name").alias("coach_name"), "specialization")
    week = (weekly_text(t.free_days).filter(F.col("user_type") == "coach")
            .select(F.col("user_id").alias("coach_id"), "week"))
    p = parse_notes_strict("notes")
    return (s.join(c.join(week, "coach_id", "left"), "coach_id")
            .select("member_id", "id", "coach_id", "coach_name", "specialization", "session_date", "session_time",
                    "duration", "status", p.workout_type.alias("workout_type"),
                    F.coalesce("week", F.lit(default_week_text())).alias("coach_week")))


# ---------------------------------------------------------------- X29 exports
def _session_cols(prefix_cols):
    return [*prefix_cols, "session_date", "session_time", F.col("notes").alias("workout_type"),
            "status", "duration", "notes"]


def export(t: Tables, name: str, as_of=None, rows: int = DASHBOARD_EXPORT_ROWS) -> DataFrame:
    """The reference's spreadsheet exports for every entity at once; dashboards keep the
    latest ``rows`` sessions of each."""
    s, m, c = t.sessions, t.members, t.coaches
    mem = m.select(F.col("id").alias("member_id"), F.col("name").alias("member_name"),
                   F.col("email").alias("member_email"))
    coa = c.select(F.col("id").alias("coach_id"), F.col("name").alias("coach_name"),
                   F.col("email").alias("coach_email"))
    if name == "schedule_coach":
        return s.join(mem, "member_id").select("coach_id", *_session_cols(["member_name", "member_email"]))
    if name == "schedule_member":
        return s.join(coa, "coach_id").select("member_id", *_session_cols(["coach_name", "coach_email"]))
    if name == "sessions_coach":
        return s.join(mem, "member_id").select(
            "coach_id", *_session_cols(["member_name", "member_email"]), "created_at")
    if name == "sessions_gym":
        return (s.join(mem, "member_id").join(coa, "coach_id")
                .select("gym_id", *_session_cols(["member_name", "member_email", "coach_name", "coach_email"]),
                        "created_at"))
    if name == "members_coach":
        per = s.groupBy("coach_id", "member_id").agg(
            F.count(F.lit(1)).alias("total_sessions"),
            F.count(F.when(F.lower("status") == "completed", 1)).alias("completed_sessions"),
            F.max("session_date").alias("last_session_date"))
        return (t.member_coach.select("coach_id", "member_id")
                .join(m.select(F.col("id").alias("member_id"), "name", "email", "membership_type"), "member_id")
                .join(per, ["coach_id", "member_id"], "left")
                .select("coach_id", "member_id", "name", "email", "membership_type",
                        F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                        F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"),
                        "last_session_date"))
    if name == "members_gym":
        per = s.groupBy("member_id").agg(
            F.count(F.lit(1)).alias("total_sessions"),
            F.count(F.when(F.lower("status") == "completed", 1)).alias("completed_sessions"),
            F.max("session_date").alias("last_session_date"))
        return (m.select("gym_id", F.col("id").alias("member_id"), "name", "email", "membership_type")
                .join(t.member_coach.select("member_id", "coach_id"), "member_id", "left")
                .join(coa, "coach_id", "left").join(per, "member_id", "left")
                .select("gym_id", "member_id", "name", "email", "membership_type", "coach_name",
                        "coach_email", F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                        F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"),
                        "last_session_date"))
    if name == "coaches_gym":
        o = at.coach_overview(c, t.member_coach.join(m.select(F.col("id").alias("member_id")), "member_id"), s)
        return o.select("gym_id", "coach_id", "name", "email", "specialization", "status",
                        F.col("total_members").alias("assigned_members"), "total_sessions",
                        "completed_sessions")
    if name == "progress_coach":
        return (s.filter(F.col("session_date") >= F.date_sub(lit_date(as_of), 30)).join(mem, "member_id")
                .select("coach_id", *_session_cols(["member_name", "member_email"])))
    if name == "progress_member":
        return s.join(coa, "coach_id").select("member_id", *_session_cols(["coach_name", "coach_email"]))
    if name in ("nutrition_coach", "nutrition_member"):
        logs = t.nutrition_logs.join(t.food_items.select(F.col("id").alias("food_item_id"),
                                                         F.col("name").alias("_fname")),
                                     "food_item_id", "left")
        cols = [F.col("created_at").alias("entry_date"), "meal_type",
                coalesce_food_name("custom_food_name", "_fname").alias("food_name"), "quantity", "unit",
                F.col("total_calories").alias("calories"), F.col("total_protein").alias("protein"),
                F.col("total_carbs").alias("carbs"), F.col("total_fat").alias("fat")]
        if name == "nutrition_member":
            return logs.select("member_id", *cols)
        return (logs.join(t.member_coach.select("member_id", "coach_id"), "member_id")
                .join(mem, "member_id").select("coach_id", "member_name", "member_email", *cols))
    if name.startswith("dashboard_"):
        key = {"dashboard_coach": "coach_id", "dashboard_member": "member_id", "dashboard_gym": "gym_id"}[name]
        # cut first: foreign keys guarantee that the joins drop no session
        top = at.latest_n(s, key, [F.desc("session_date"), F.desc("session_time"), F.desc("id")], rows)
        top = top.join(mem, "member_id").join(coa, "coach_id")
        return top.select(key, "member_name", "member_email", "coach_name", "coach_email", "session_date",
                          "session_time", F.col("notes").alias("workout_type"), "status", "duration")
    if name == "analytics_gym":
        return at.coach_analytics(c, s)
    raise KeyError(name)


EXPORTS = ("schedule_coach", "schedule_member", "sessions_coach", "sessions_gym", "members_coach",
           "members_gym", "coaches_gym", "progress_coach", "progress_member", "nutrition_coach",
           "nutrition_member", "dashboard_coach", "dashboard_member", "dashboard_gym", "analytics_gym")
