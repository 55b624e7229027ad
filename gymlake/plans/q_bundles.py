"""Registered queries: feeds, progress and dashboard lists, schedules, imports and upserts
that complete the bundles (X10, X13, X19, X23, X26, X29, X30, X33, X35, X37, X38, X40, A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.functions.notes import parse_notes_sql, parse_notes_strict
from gymlake.functions.nutrition_fx import num_or_zero
from gymlake.functions.text import coalesce_food_name
from gymlake.functions.timeutil import fmt_date, fmt_time, lit_date, start_ts
from gymlake.operators import attendance as at
from gymlake.operators import filters as flt
from gymlake.operators import meal_plans as mp
from gymlake.operators import scheduling as sc
from gymlake.operators import upserts as up
from gymlake.operators.nutrition import MACROS, UNITS
from gymlake.operators.ordering import order_sessions
from gymlake.plans import reports as rp
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import q
from gymlake.sources.fixtures import NUTRITION_AS_OF, SESSION_AS_OF

D = f"DATE '{SESSION_AS_OF}'"
STRICT_TYPE = ("CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 "
               "AND string_split(s.notes, chr(10))[1] LIKE '%Workout Type:%' "
               "THEN regexp_replace(string_split(string_split(s.notes, chr(10))[1], 'Workout Type:')[2], "
               "'^\\s+|\\s+$', '', 'g') ELSE 'Custom' END")
SQL_TYPE = "trim(split_part(string_split(notes, 'Workout Type:')[-1], chr(10), 1))"

# an entry id for the nutrition log, which has none: its place by all its columns
LOG_ORDER = "created_at DESC, food_item_id DESC, total_calories DESC, total_protein DESC, total_carbs DESC, quantity DESC"


def _latest():
    return [F.desc("session_date"), F.desc("session_time"), F.desc("id")]


def _log_order():
    return [F.desc(c) for c in ("created_at", "food_item_id", "total_calories", "total_protein", "total_carbs", "quantity")]


# ---------------------------------------------------------------- X38 feeds
def _food_names(top, t):
    foods = t.food_items.select(F.col("id").alias("food_item_id"), F.col("name").alias("_f"))
    return top.join(foods, "food_item_id", "left").withColumn("food_name", coalesce_food_name("custom_food_name", "_f"))


@register("coach_nutrition_feed", f"""
SELECT coach_id, rank_in_group, x.member_id, m.name AS member_name, meal_type,
       COALESCE(custom_food_name, f.name) AS food_name, total_calories, total_protein
FROM (SELECT mc.coach_id, n.*, CAST(row_number() OVER (PARTITION BY mc.coach_id
             ORDER BY {LOG_ORDER}, n.member_id DESC) AS INTEGER) AS rank_in_group
      FROM nutrition_logs n JOIN member_coach mc ON mc.member_id = n.member_id) x
JOIN members m ON m.id = x.member_id LEFT JOIN food_items f ON f.id = x.food_item_id
WHERE rank_in_group <= 5
""", ["nutrition_logs", "member_coach", "members", "food_items"], "X38 W2 P14")
def _coach_nutrition_feed(t):
    # a coach's five latest are among the five latest of each of the coach's members
    per_member = at.latest_n(t.nutrition_logs, "member_id", _log_order(), 5).drop("rank_in_group")
    mine = per_member.join(t.member_coach.select("coach_id", "member_id"), "member_id")
    top = at.latest_n(mine, "coach_id", [*_log_order(), F.desc("member_id")], 5)
    named = _food_names(top, t).join(t.members.select(F.col("id").alias("member_id"), F.col("name").alias("member_name")), "member_id")
    return named.select("coach_id", "rank_in_group", "member_id", "member_name", "meal_type", "food_name",
                        "total_calories", "total_protein")


@register("member_nutrition_feed", f"""
SELECT x.member_id, rank_in_group, meal_type, COALESCE(custom_food_name, f.name) AS food_name, quantity, unit,
       total_calories, total_protein, total_carbs, total_fat, created_at
FROM (SELECT n.*, CAST(row_number() OVER (PARTITION BY member_id ORDER BY {LOG_ORDER}) AS INTEGER) AS rank_in_group
      FROM nutrition_logs n) x LEFT JOIN food_items f ON f.id = x.food_item_id
WHERE rank_in_group <= 50
""", ["nutrition_logs", "food_items"], "X38 W2 P14")
def _member_nutrition_feed(t):
    top = at.latest_n(t.nutrition_logs, "member_id", _log_order(), 50)
    return _food_names(top, t).select("member_id", "rank_in_group", "meal_type", "food_name", "quantity", "unit",
                                      *[f"total_{m}" for m in MACROS], "created_at")


@register("member_nutrition_dashboard", f"""
WITH day AS (SELECT member_id, COUNT(*) AS entries, SUM(CAST(total_calories AS DOUBLE)) AS calories,
                    SUM(CAST(total_protein AS DOUBLE)) AS protein
             FROM nutrition_logs WHERE created_at >= TIMESTAMP '{NUTRITION_AS_OF} 00:00:00'
               AND created_at < TIMESTAMP '{NUTRITION_AS_OF} 00:00:00' + INTERVAL 1 DAY GROUP BY member_id)
SELECT m.id AS member_id, m.name, COALESCE(day.entries, 0) AS entries, COALESCE(day.calories, 0.0) AS calories,
       COALESCE(day.protein, 0.0) AS protein, COALESCE(CAST(g.daily_calorie_goal AS DOUBLE), 0.0) AS calorie_goal
FROM members m LEFT JOIN day ON day.member_id = m.id LEFT JOIN nutrition_goals g ON g.member_id = m.id
""", ["members", "nutrition_logs", "nutrition_goals"], "X38 P12 F26 A21")
def _member_nutrition_dashboard(t):
    day = flt.on_day(t.nutrition_logs, "created_at", NUTRITION_AS_OF).groupBy("member_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.col("total_calories").cast("double")).alias("calories"),
        F.sum(F.col("total_protein").cast("double")).alias("protein"))
    goals = t.nutrition_goals.select("member_id", "daily_calorie_goal")
    return (t.members.select(F.col("id").alias("member_id"), "name").join(day, "member_id", "left").join(goals, "member_id", "left")
            .select("member_id", "name", F.coalesce("entries", F.lit(0)).alias("entries"),
                    num_or_zero("calories").alias("calories"), num_or_zero("protein").alias("protein"),
                    num_or_zero("daily_calorie_goal").alias("calorie_goal")))


# ---------------------------------------------------------------- X26, X35, X37
@register("member_session_history", f"""
SELECT member_id, strftime(session_date, '%Y-%m-%d') AS date, COUNT(*) AS count
FROM sessions WHERE session_date >= {D} - 30 GROUP BY member_id, session_date
""", ["sessions"], "X26 F9")
def _member_session_history(t):
    s = t.sessions.filter(F.col("session_date") >= F.date_sub(lit_date(SESSION_AS_OF), 30))
    return (s.groupBy("member_id", "session_date").agg(F.count(F.lit(1)).alias("count"))
            .select("member_id", fmt_date("session_date").alias("date"), "count"))


@register("member_workouts", f"""
SELECT member_id, {SQL_TYPE} AS workout_type, COUNT(*) AS count FROM sessions
WHERE notes ILIKE '%Workout Type:%' GROUP BY 1, 2
""", ["sessions"], "X26 F3")
def _member_workouts(t):
    s = t.sessions.filter(F.col("notes").ilike("%Workout Type:%"))
    return s.groupBy("member_id", parse_notes_sql("notes").workout_type.alias("workout_type")).agg(F.count(F.lit(1)).alias("count"))


@register("member_recent_sessions", """
SELECT x.member_id, x.id, c.name AS coach_name, g.name AS gym_name, strftime(x.session_date, '%Y-%m-%d') AS date,
       substr(x.session_time, 1, 5) AS time, x.status, rank_in_group
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY member_id ORDER BY session_date DESC, session_time DESC, id DESC)
             AS INTEGER) AS rank_in_group FROM sessions) x
JOIN coaches c ON c.id = x.coach_id JOIN gyms g ON g.id = x.gym_id
WHERE rank_in_group <= 5
""", ["sessions", "coaches", "gyms"], "X26 J2 W2 F9")
def _member_recent_sessions(t):
    top = at.latest_n(t.sessions, "member_id", _latest(), 5)
    return (at.member_session_history(top, t.coaches, t.gyms)
            .select("member_id", "id", "coach_name", "gym_name", fmt_date("session_date").alias("date"),
                    fmt_time(start_ts("session_date", "session_time")).alias("time"), "status", "rank_in_group"))


@register("coach_recent_sessions", f"""
SELECT x.coach_id, x.id, m.name AS member_name, m.membership_type, x.session_date, x.session_time, workout_type, rank_in_group
FROM (SELECT s.*, {STRICT_TYPE} AS workout_type, CAST(row_number() OVER (PARTITION BY coach_id
             ORDER BY session_date DESC, session_time DESC, id DESC) AS INTEGER) AS rank_in_group FROM sessions s) x
JOIN members m ON m.id = x.member_id WHERE rank_in_group <= 5
""", ["sessions", "members"], "X37 W2 F1 J1")
def _coach_recent_sessions(t):
    top = at.latest_n(t.sessions, "coach_id", _latest(), 5)
    mem = t.members.select(F.col("id").alias("member_id"), F.col("name").alias("member_name"), "membership_type")
    return top.join(mem, "member_id").select("coach_id", "id", "member_name", "membership_type", "session_date", "session_time",
                                             parse_notes_strict("notes").workout_type.alias("workout_type"), "rank_in_group")


@register("newest_members", """
SELECT gym_id, id, name, email, membership_type, join_date, rank_in_group
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY gym_id ORDER BY join_date DESC, id DESC) AS INTEGER) AS rank_in_group
      FROM members) x WHERE rank_in_group <= 5
""", ["members"], "X37 W2")
def _newest_members(t):
    top = at.latest_n(t.members, "gym_id", [F.desc("join_date"), F.desc("id")], 5)
    return top.select("gym_id", "id", "name", "email", "membership_type", "join_date", "rank_in_group")


@register("member_detail_overview", """
SELECT mc.coach_id, m.id AS member_id, m.name, m.email, m.membership_type, mc.assigned_date,
       COALESCE(s.total_sessions, 0) AS total_sessions, COALESCE(s.completed_sessions, 0) AS completed_sessions,
       s.last_session
FROM members m JOIN member_coach mc ON mc.member_id = m.id
LEFT JOIN (SELECT member_id, COUNT(*) AS total_sessions,
                  CAST(SUM(CASE WHEN lower(status) = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed_sessions,
                  MAX(CASE WHEN lower(status) = 'completed' THEN session_date END) AS last_session
           FROM sessions GROUP BY member_id) s ON s.member_id = m.id
""", ["members", "member_coach", "sessions"], "X35 A2 A5 J24")
def _member_detail_overview(t):
    done = F.lower("status") == "completed"
    per = t.sessions.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count(F.when(done, 1)).alias("completed_sessions"),
        F.max(F.when(done, F.col("session_date"))).alias("last_session"))
    m = t.members.select(F.col("id").alias("member_id"), "name", "email", "membership_type")
    return (t.member_coach.join(m, "member_id").join(per, "member_id", "left")
            .select("coach_id", "member_id", "name", "email", "membership_type", "assigned_date",
                    F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                    F.coalesce("completed_sessions", F.lit(0)).alias("completed_sessions"), "last_session"))


# ---------------------------------------------------------------- X33, A24, P2, P16, O1
@register("member_schedule", f"""
WITH wk AS (SELECT user_id, string_agg(day_of_week || ' ' || CASE WHEN is_available THEN start_time || '-' || end_time ELSE 'off' END,
                   '; ' ORDER BY CASE day_of_week WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3
                   WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 ELSE 7 END) AS week
            FROM free_days WHERE user_type = 'coach' GROUP BY user_id)
SELECT s.member_id, s.id, s.coach_id, c.name AS coach_name, c.specialization, s.session_date, s.session_time, s.duration,
       s.status, {STRICT_TYPE} AS workout_type, COALESCE(wk.week, {q(rp.default_week_text())}) AS coach_week
FROM sessions s JOIN coaches c ON c.id = s.coach_id LEFT JOIN wk ON wk.user_id = s.coach_id
WHERE s.session_date BETWEEN DATE '2024-01-15' AND {D}
""", ["sessions", "coaches", "free_days"], "X33 P5 F1 O2 F16")
def _member_schedule(t):
    return rp.member_schedule(t, "2024-01-15", SESSION_AS_OF)


@register("sessions_by_slot", """
SELECT coach_id, dayname(session_date) || '_' || CAST(split_part(session_time, ':', 1) AS INTEGER) AS slot,
       COUNT(*) AS sessions, string_agg(CAST(id AS VARCHAR), ',' ORDER BY session_date, session_time, id) AS session_ids
FROM sessions WHERE session_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' GROUP BY 1, 2
""", ["sessions"], "A24 F10 P16")
def _sessions_by_slot(t):
    s = t.sessions.filter(F.col("session_date").between(lit_date("2024-01-22"), lit_date("2024-01-28")))
    p = parse_notes_strict("notes")
    named = at.sessions_with_member(s, t.members).withColumns({"workout_type": p.workout_type, "exercises": p.exercises})
    slots = sc.sessions_by_slot(named, "coach_id")
    return slots.select("coach_id", "slot", F.size("sessions").cast("long").alias("sessions"),
                        F.array_join(F.transform("sessions", lambda x: x["id"].cast("string")), ",").alias("session_ids"))


@register("plans_by_member", """
SELECT np.member_id, m.name, m.email, COUNT(*) AS plans,
       string_agg(CAST(np.id AS VARCHAR) || CASE WHEN np.is_active THEN '+' ELSE '-' END, ','
                  ORDER BY np.created_at DESC, np.id DESC) AS plan_ids
FROM nutrition_plans np JOIN members m ON m.id = np.member_id GROUP BY 1, 2, 3
""", ["nutrition_plans", "members"], "A24 P15")
def _plans_by_member(t):
    b = mp.plans_by_member(t.nutrition_plans, t.members)
    mark = lambda p: F.concat(p["plan_id"].cast("string"), F.when(p["status"] == "active", "+").otherwise("-"))
    return b.select("member_id", "name", "email", F.size("plans").cast("long").alias("plans"),
                    F.array_join(F.transform("plans", mark), ",").alias("plan_ids"))


@register("one_coach_week", f"""
SELECT id, member_id, strftime(session_date, '%Y-%m-%d') AS date, row_number() OVER (ORDER BY session_date, session_time, id) AS place
FROM sessions WHERE coach_id = 3 AND session_date BETWEEN DATE '2024-01-19' AND {D}
""", ["sessions"], "P2 O1 P5")
def _one_coach_week(t):
    s = flt.between_dates(flt.for_entity(t.sessions, "coach_id", 3), "session_date",
                          "2024-01-19", SESSION_AS_OF)
    # one coach's week: the place proves the order of the rows
    from pyspark.sql import Window
    w = Window.partitionBy("coach_id").orderBy("session_date", "session_time", "id")
    return order_sessions(s).select("id", "member_id", fmt_date("session_date").alias("date"),
                                    F.row_number().over(w).cast("long").alias("place"))


@register("users_availability", """
SELECT user_id, user_type, slot_date, array_to_string(list_sort(list(hour) FILTER (WHERE is_available)), ',') AS available_hours
FROM availability_slots WHERE user_id IN (1, 2, 3, 5, 8, 13, 21) AND user_type = 'member'
  AND slot_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'
GROUP BY 1, 2, 3
""", ["availability_slots"], "X40 P9 P5 A24")
def _users_availability(t):
    s = flt.with_ids(t.availability_slots.filter(F.col("user_type") == "member"), "user_id", [1, 2, 3, 5, 8, 13, 21])
    m = sc.availability_map(s, "2024-01-08", "2024-01-15")
    return m.select("user_id", "user_type", "slot_date",
                    F.when(F.size("available_hours") > 0, F.array_join("available_hours", ",")).alias("available_hours"))


# ---------------------------------------------------------------- X10, X13, X19, X23, X30
@register("upsert_preferences", """
WITH w AS (SELECT user_id, user_type, preferred_duration, created_at, 0 AS prio, CAST(0 AS BIGINT) AS seq FROM stored_preferences
           UNION ALL SELECT user_id, user_type, preferred_duration, created_at, 1, seq FROM preference_updates)
SELECT user_id, user_type, preferred_duration, created_at FROM (
  SELECT user_id, user_type, preferred_duration, MIN(created_at) OVER (PARTITION BY user_id, user_type) AS created_at,
         row_number() OVER (PARTITION BY user_id, user_type ORDER BY prio DESC, seq DESC) AS rn FROM w) x WHERE rn = 1
""", ["stored_preferences", "preference_updates"], "X10 W5")
def _upsert_preferences(t):
    base = t.stored_preferences.withColumn("seq", F.lit(0).cast("long"))
    return up.upsert(base, t.preference_updates, ["user_id", "user_type"], "seq").drop("seq")


@register("upsert_week", """
WITH w AS (SELECT user_id, user_type, day_of_week, is_available, start_time, end_time, 0 AS prio, CAST(0 AS BIGINT) AS seq FROM free_days
           UNION ALL SELECT user_id, user_type, day_of_week, is_available, start_time, end_time, 1, seq FROM week_updates)
SELECT user_id, user_type, day_of_week, is_available, start_time, end_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, user_type, day_of_week ORDER BY prio DESC, seq DESC) AS rn FROM w) x WHERE rn = 1
""", ["free_days", "week_updates"], "X10 W5")
def _upsert_week(t):
    base = t.free_days.withColumn("seq", F.lit(0).cast("long"))
    return up.upsert(base, t.week_updates, ["user_id", "user_type", "day_of_week"], "seq", keep_first=()).drop("seq")


@register("guarded_delete", """
SELECT c.id, c.gym_id, c.name FROM coaches c
WHERE NOT EXISTS (SELECT 1 FROM coach_delete_requests d WHERE d.id = c.id AND d.gym_id = c.gym_id)
""", ["coaches", "coach_delete_requests"], "X13")
def _guarded_delete(t):
    return up.guarded_delete(t.coaches, t.coach_delete_requests, "id", "gym_id").select("id", "gym_id", "name")


@register("meal_correction", f"""
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, member_id ORDER BY seq DESC) AS rn FROM meal_patches
                             WHERE unit IN ({', '.join(q(u) for u in UNITS)}) AND custom_food_name IS NOT NULL) x WHERE rn = 1)
SELECT l.id, l.member_id, COALESCE(p.custom_food_name, l.custom_food_name) AS custom_food_name,
       COALESCE(p.unit, l.unit) AS unit, COALESCE(p.quantity, l.quantity) AS quantity,
       COALESCE(p.total_calories, l.total_calories) AS total_calories
FROM meal_logs l LEFT JOIN last p ON p.id = l.id AND p.member_id = l.member_id
""", ["meal_logs", "meal_patches"], "X19")
def _meal_correction(t):
    return up.meal_corrections(t.meal_logs, t.meal_patches, UNITS).select(
        "id", "member_id", "custom_food_name", "unit", "quantity", "total_calories")


@register("validate_coaches", f"""
WITH pre AS (
  SELECT i.*, CASE WHEN name IS NULL OR email IS NULL OR specialization IS NULL THEN {q(up.COACH_REASONS['missing'])}
                   WHEN NOT (contains(email, '@') AND contains(email, '.')) THEN {q(up.COACH_REASONS['email'])}
                   WHEN EXISTS (SELECT 1 FROM coaches c WHERE lower(c.email) = lower(i.email)) THEN {q(up.COACH_REASONS['duplicate'])} END AS p
  FROM coach_imports i),
f AS (SELECT lower(email) AS email, MIN(import_id) AS first_id FROM pre WHERE p IS NULL GROUP BY 1)
SELECT import_id, gym_id, name, pre.email, specialization,
       COALESCE(p, CASE WHEN f.first_id < import_id THEN {q(up.COACH_REASONS['batch'])} END) AS reason,
       COALESCE(p, CASE WHEN f.first_id < import_id THEN 'x' END) IS NULL AS accepted
FROM pre LEFT JOIN f ON f.email = lower(pre.email)
""", ["coach_imports", "coaches"], "X23 F5 J12")
def _validate_coaches(t):
    return up.validate_coaches(t.coach_imports, t.coaches)


@register("create_plans", """
SELECT r.request_id, r.coach_id, r.member_id, r.plan_name, r.daily_calories, a.member_id IS NOT NULL AS accepted,
       CASE WHEN a.member_id IS NULL THEN 'Member not found' END AS reason
FROM plan_requests r
LEFT JOIN (SELECT DISTINCT mc.coach_id, mc.member_id FROM member_coach mc JOIN members m ON m.id = mc.member_id) a
  ON a.coach_id = r.coach_id AND a.member_id = r.member_id
""", ["plan_requests", "member_coach", "members"], "X30 J9")
def _create_plans(t):
    return mp.create_plans(t.plan_requests, t.members, t.member_coach)


# ---------------------------------------------------------------- X29: the six exports that were not registered
_MEM = "m.name AS member_name, m.email AS member_email"
_COA = "c.name AS coach_name, c.email AS coach_email"
_S = "s.session_date, s.session_time, s.notes AS workout_type, s.status, s.duration, s.notes"


def _export(name, sql, tables, **kw):
    @register(f"export_{name}", sql, tables, "X29")
    def _build(t):
        return rp.export(t, name, **kw)


_export("schedule_coach", f"SELECT s.coach_id, {_MEM}, {_S} FROM sessions s JOIN members m ON m.id = s.member_id", ["sessions", "members"])
_export("sessions_coach", f"SELECT s.coach_id, {_MEM}, {_S}, s.created_at FROM sessions s JOIN members m ON m.id = s.member_id",
        ["sessions", "members"])
_export("progress_member", f"SELECT s.member_id, {_COA}, {_S} FROM sessions s JOIN coaches c ON c.id = s.coach_id", ["sessions", "coaches"])
_export("nutrition_member", """
SELECT n.member_id, n.created_at AS entry_date, n.meal_type, COALESCE(n.custom_food_name, f.name) AS food_name, n.quantity, n.unit,
       n.total_calories AS calories, n.total_protein AS protein, n.total_carbs AS carbs, n.total_fat AS fat
FROM nutrition_logs n LEFT JOIN food_items f ON f.id = n.food_item_id""", ["nutrition_logs", "food_items"])
for _key in ("coach", "member"):
    _export(f"dashboard_{_key}", f"""
SELECT s.{_key}_id, {_MEM}, {_COA}, s.session_date, s.session_time, s.notes AS workout_type, s.status, s.duration
FROM (SELECT *, row_number() OVER (PARTITION BY {_key}_id ORDER BY session_date DESC, session_time DESC, id DESC) AS rn FROM sessions) s
JOIN members m ON m.id = s.member_id JOIN coaches c ON c.id = s.coach_id WHERE rn <= 50""", ["sessions", "members", "coaches"])
