"""Registered queries: report bundles and exports."""

from __future__ import annotations

from gymlake.functions.timeutil import WEEKDAYS
from gymlake.plans import reports as rp
from gymlake.plans.catalog import register
from gymlake.plans.q_attendance import COMPLETED, CANCELLED
from gymlake.sources.fixtures import SESSION_AS_OF
from gymlake.sources.json_docs import DEFAULT_TIME_SLOTS

AS_OF = SESSION_AS_OF
D = f"DATE '{AS_OF}'"
PRICE = "CASE membership_type WHEN 'Basic' THEN 50.0 WHEN 'Premium' THEN 100.0 WHEN 'VIP' THEN 150.0 END"
STRICT_TYPE = ("CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 "
               "AND string_split(s.notes, chr(10))[1] LIKE '%Workout Type:%' "
               "THEN regexp_replace(string_split(string_split(s.notes, chr(10))[1], 'Workout Type:')[2], "
               "'^\\s+|\\s+$', '', 'g') ELSE 'Custom' END")
STRICT_EX = ("CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 THEN "
             "array_to_string(list_filter(list_transform(string_split(s.notes, chr(10))[2:], "
             "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '^[0-9]')), '|') "
             "ELSE '' END")
SQL_TYPE = "trim(split_part(string_split(notes, 'Workout Type:')[-1], chr(10), 1))"


@register("gym_report_summary", f"""
WITH mem AS (SELECT gym_id, COUNT(*) AS total_members,
                    CAST(SUM(CASE WHEN join_date >= {D} - 30 THEN 1 ELSE 0 END) AS BIGINT) AS new_members
             FROM members GROUP BY gym_id),
ses AS (SELECT gym_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions,
               SUM({CANCELLED}) AS cancelled_sessions, COUNT(DISTINCT member_id) AS active_members,
               COUNT(DISTINCT coach_id) AS active_coaches
        FROM sessions WHERE session_date >= {D} - 30 GROUP BY gym_id),
rev AS (SELECT gym_id, ROUND(SUM({PRICE}), 2)::DOUBLE AS monthly_revenue,
               COUNT(CASE WHEN membership_type = 'Basic' THEN 1 END) AS basic_members,
               COUNT(CASE WHEN membership_type = 'Premium' THEN 1 END) AS premium_members,
               COUNT(CASE WHEN membership_type = 'VIP' THEN 1 END) AS vip_members
        FROM members GROUP BY gym_id)
SELECT g.id AS gym_id, g.name AS gym_name, COALESCE(mem.total_members, 0) AS total_members,
       COALESCE(mem.new_members, 0) AS new_members, COALESCE(ses.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(ses.completed_sessions, 0) AS BIGINT) AS completed_sessions,
       CAST(COALESCE(ses.cancelled_sessions, 0) AS BIGINT) AS cancelled_sessions,
       COALESCE(ses.active_members, 0) AS active_members, COALESCE(ses.active_coaches, 0) AS active_coaches,
       COALESCE(rev.basic_members, 0) AS basic_members, COALESCE(rev.premium_members, 0) AS premium_members,
       COALESCE(rev.vip_members, 0) AS vip_members, COALESCE(rev.monthly_revenue, 0.0) AS monthly_revenue,
       round(COALESCE(round_even(CAST(COALESCE(ses.completed_sessions, 0) AS DOUBLE) * 100.0
                                 / NULLIF(COALESCE(ses.total_sessions, 0), 0), 6), 0.0), 1) AS completion_rate
FROM gyms g LEFT JOIN mem ON mem.gym_id = g.id LEFT JOIN ses ON ses.gym_id = g.id
LEFT JOIN rev ON rev.gym_id = g.id
""", ["gyms", "members", "sessions"], "X28 A7 A13 A14")
def _gym_report_summary(t):
    return rp.gym_report_summary(t, AS_OF)


@register("member_dashboard", f"""
WITH st AS (
  SELECT member_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions,
         SUM({CANCELLED}) AS cancelled_sessions,
         SUM(CASE WHEN session_date >= {D} THEN 1 ELSE 0 END) AS upcoming_sessions,
         SUM(CASE WHEN session_date >= {D} - 7 THEN 1 ELSE 0 END) AS week_sessions,
         SUM(CASE WHEN session_date >= {D} - 7 AND lower(status) = 'completed' THEN 1 ELSE 0 END)
           AS week_completed_sessions
  FROM sessions GROUP BY member_id),
d AS (SELECT DISTINCT member_id, session_date FROM sessions
      WHERE lower(status) = 'completed' AND session_date <= {D}),
g AS (SELECT member_id, session_date - CAST(row_number() OVER (PARTITION BY member_id ORDER BY session_date)
                                            AS INTEGER) AS grp, session_date FROM d),
r AS (SELECT member_id, grp, COUNT(*) AS run_len, MAX(session_date) AS run_end FROM g GROUP BY 1, 2),
sk AS (SELECT member_id, MAX(run_len) AS longest_streak,
              COALESCE(MAX(CASE WHEN run_end >= {D} - 1 THEN run_len END), 0) AS current_streak
       FROM r GROUP BY member_id),
fc AS (SELECT f.member_id, f.coach_id, c.name AS coach_name
       FROM (SELECT member_id, min(coach_id) AS coach_id FROM member_coach GROUP BY member_id) f
       LEFT JOIN coaches c ON c.id = f.coach_id)
SELECT m.id AS member_id, m.name, m.membership_type, fc.coach_id, fc.coach_name,
       COALESCE(st.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(st.completed_sessions, 0) AS BIGINT) AS completed_sessions,
       CAST(COALESCE(st.cancelled_sessions, 0) AS BIGINT) AS cancelled_sessions,
       CAST(COALESCE(st.upcoming_sessions, 0) AS BIGINT) AS upcoming_sessions,
       CAST(COALESCE(st.week_sessions, 0) AS BIGINT) AS week_sessions,
       CAST(COALESCE(st.week_completed_sessions, 0) AS BIGINT) AS week_completed_sessions,
       CAST(COALESCE(round_even(CAST(st.week_completed_sessions AS DOUBLE) * 100.0
                                / NULLIF(st.week_sessions, 0), 0), 0) AS INTEGER) AS week_progress,
       COALESCE(sk.current_streak, 0) AS current_streak, COALESCE(sk.longest_streak, 0) AS longest_streak
FROM members m LEFT JOIN st ON st.member_id = m.id LEFT JOIN sk ON sk.member_id = m.id
LEFT JOIN fc ON fc.member_id = m.id
""", ["members", "sessions", "member_coach", "coaches"], "X27 A1 A8 W1 J4")
def _member_dashboard(t):
    return rp.member_dashboard(t, AS_OF)


@register("coach_progress", f"""
WITH s AS (SELECT s.*, mc.coach_id AS scope_coach FROM sessions s JOIN member_coach mc
           ON s.member_id = mc.member_id WHERE s.session_date >= {D} - 90),
st AS (SELECT scope_coach AS coach_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions,
              SUM({CANCELLED}) AS cancelled_sessions FROM s GROUP BY 1),
dist AS (SELECT scope_coach AS coach_id, {SQL_TYPE} AS workout_type, COUNT(*) AS n
         FROM s WHERE notes ILIKE '%Workout Type:%' GROUP BY 1, 2),
cm AS (SELECT coach_id, workout_type FROM (
         SELECT *, row_number() OVER (PARTITION BY coach_id ORDER BY n DESC, workout_type) AS rn FROM dist) x
       WHERE rn = 1),
ty AS (SELECT coach_id, COUNT(*) AS workout_types FROM dist GROUP BY 1),
dy AS (SELECT scope_coach AS coach_id, COUNT(DISTINCT session_date) AS active_days FROM s GROUP BY 1)
SELECT c.id AS coach_id, c.name, COALESCE(st.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(st.completed_sessions, 0) AS BIGINT) AS completed_sessions,
       CAST(COALESCE(st.cancelled_sessions, 0) AS BIGINT) AS cancelled_sessions,
       CAST(COALESCE(round_even(CAST(st.completed_sessions AS DOUBLE) * 100.0 / NULLIF(st.total_sessions, 0), 0),
                     0) AS INTEGER) AS attendance_rate,
       COALESCE(ty.workout_types, 0) AS workout_types, COALESCE(dy.active_days, 0) AS active_days,
       COALESCE(cm.workout_type, 'No data') AS common_workout
FROM coaches c LEFT JOIN st ON st.coach_id = c.id LEFT JOIN cm ON cm.coach_id = c.id
LEFT JOIN ty ON ty.coach_id = c.id LEFT JOIN dy ON dy.coach_id = c.id
""", ["coaches", "sessions", "member_coach"], "X25 A1 A8 A10 A11 A12")
def _coach_progress(t):
    return rp.coach_progress(t, "quarter", AS_OF)


@register("member_progress", f"""
WITH st AS (SELECT member_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions
            FROM sessions GROUP BY member_id),
dist AS (SELECT member_id, {SQL_TYPE} AS workout_type, COUNT(*) AS n FROM sessions
         WHERE notes ILIKE '%Workout Type:%' GROUP BY 1, 2),
cm AS (SELECT member_id, workout_type FROM (
         SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY n DESC, workout_type) AS rn FROM dist) x
       WHERE rn = 1)
SELECT m.id AS member_id, m.name, st.total_sessions, CAST(st.completed_sessions AS BIGINT) AS completed_sessions,
       CAST(COALESCE(round_even(CAST(st.completed_sessions AS DOUBLE) * 100.0 / NULLIF(st.total_sessions, 0), 0),
                     0) AS INTEGER) AS attendance_rate,
       COALESCE(cm.workout_type, 'No data') AS common_workout
FROM members m JOIN st ON st.member_id = m.id LEFT JOIN cm ON cm.member_id = m.id
""", ["members", "sessions"], "X26 A10 A8")
def _member_progress(t):
    return rp.member_progress(t, AS_OF)


@register("member_detail", f"""
SELECT coach_id, member_id, id, session_date, session_time, status, workout_type, exercises, rank_in_group
FROM (SELECT s.coach_id, s.member_id, s.id, s.session_date, s.session_time, s.status,
             {STRICT_TYPE} AS workout_type, {STRICT_EX} AS exercises,
             CAST(row_number() OVER (PARTITION BY s.coach_id, s.member_id
                                ORDER BY s.session_date DESC, s.session_time DESC, s.id DESC) AS INTEGER)
               AS rank_in_group
      FROM sessions s
      WHERE EXISTS (SELECT 1 FROM member_coach mc WHERE mc.coach_id = s.coach_id
                    AND mc.member_id = s.member_id)) x
WHERE rank_in_group <= 10
""", ["sessions", "member_coach"], "X35 W2 J9 F1")
def _member_detail(t):
    return rp.member_detail(t, 10)


@register("sessions_by_day", """
WITH spine AS (SELECT g.id AS gym_id, CAST(d AS DATE) AS session_date
               FROM gyms g, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31',
                                                           INTERVAL 1 DAY)) AS d) dd),
per AS (SELECT gym_id, session_date, COUNT(*) AS sessions, min(session_time) AS first_time,
               max(session_time) AS last_time
        FROM sessions WHERE session_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1, 2)
SELECT sp.gym_id, sp.session_date, COALESCE(per.sessions, 0) AS sessions, per.first_time, per.last_time
FROM spine sp LEFT JOIN per ON per.gym_id = sp.gym_id AND per.session_date = sp.session_date
""", ["gyms", "sessions"], "X39 J18 F12")
def _sessions_by_day(t):
    return rp.sessions_by_day(t, "2024-01-01", "2024-01-31")


_DOW = ("CASE day_of_week WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
        "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 WHEN 'Sunday' THEN 7 END")
_WEEK = f"""
wk AS (SELECT user_id, user_type,
              string_agg(day_of_week || ' ' || CASE WHEN is_available THEN start_time || '-' || end_time
                                                    ELSE 'off' END, '; ' ORDER BY {_DOW}) AS week
       FROM free_days GROUP BY user_id, user_type)"""
_DEFAULT_WEEK = "; ".join(f"{w} 08:00-20:00" for w in WEEKDAYS)
_DEFAULT_SLOTS = ",".join(DEFAULT_TIME_SLOTS)


@register("user_profile", f"""
WITH {_WEEK},
p AS (SELECT user_id, user_type, preferred_duration,
             CASE WHEN json_valid(preferred_time_slots)
                  THEN array_to_string(from_json(preferred_time_slots, '["VARCHAR"]'), ',') END AS slots,
             CASE WHEN json_valid(preferred_workout_types)
                  THEN array_to_string(from_json(preferred_workout_types, '["VARCHAR"]'), ',') END AS types
      FROM user_preferences)
SELECT u.id AS user_id, u.user_type, u.name, COALESCE(p.preferred_duration, 60) AS preferred_duration,
       COALESCE(p.slots, '{_DEFAULT_SLOTS}') AS preferred_time_slots,
       COALESCE(p.types, '') AS preferred_workout_types,
       COALESCE(wk.week, '{_DEFAULT_WEEK}') AS week
FROM all_users u LEFT JOIN p ON p.user_id = u.id AND p.user_type = u.user_type
LEFT JOIN wk ON wk.user_id = u.id AND wk.user_type = u.user_type
""", ["all_users", "user_preferences", "free_days"], "X34 S4 F16 J16 O2 A25")
def _user_profile(t):
    return rp.user_profile(t)


@register("coach_schedule", f"""
WITH {_WEEK}
SELECT s.coach_id, s.id, s.member_id, m.name AS member_name, s.session_date, s.session_time, s.duration,
       s.status, {STRICT_TYPE} AS workout_type,
       COALESCE(wk.week, '{_DEFAULT_WEEK}') AS coach_week
FROM sessions s JOIN members m ON m.id = s.member_id
LEFT JOIN wk ON wk.user_id = s.coach_id AND wk.user_type = 'coach'
WHERE s.session_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'
""", ["sessions", "members", "free_days"], "X33 J1 P5 F1 O2 F16")
def _coach_schedule(t):
    return rp.coach_schedule(t, "2024-01-15", "2024-01-21")


_SESS_COLS = "s.session_date, s.session_time, s.notes AS workout_type, s.status, s.duration, s.notes"


@register("export_sessions_gym", f"""
SELECT s.gym_id, m.name AS member_name, m.email AS member_email, c.name AS coach_name, c.email AS coach_email,
       {_SESS_COLS}, s.created_at
FROM sessions s JOIN members m ON s.member_id = m.id JOIN coaches c ON s.coach_id = c.id
""", ["sessions", "members", "coaches"], "X29 J3")
def _export_sessions_gym(t):
    return rp.export(t, "sessions_gym")


@register("export_schedule_member", f"""
SELECT s.member_id, c.name AS coach_name, c.email AS coach_email, {_SESS_COLS}
FROM sessions s JOIN coaches c ON s.coach_id = c.id
""", ["sessions", "coaches"], "X29")
def _export_schedule_member(t):
    return rp.export(t, "schedule_member")


@register("export_progress_coach", f"""
SELECT s.coach_id, m.name AS member_name, m.email AS member_email, {_SESS_COLS}
FROM sessions s JOIN members m ON s.member_id = m.id WHERE s.session_date >= {D} - 30
""", ["sessions", "members"], "X29 P3")
def _export_progress_coach(t):
    return rp.export(t, "progress_coach", AS_OF)


@register("export_members_coach", """
SELECT mc.coach_id, m.id AS member_id, m.name, m.email, m.membership_type,
       COUNT(s.id) AS total_sessions, COUNT(CASE WHEN lower(s.status) = 'completed' THEN 1 END) AS completed_sessions,
       MAX(s.session_date) AS last_session_date
FROM members m JOIN member_coach mc ON m.id = mc.member_id
LEFT JOIN sessions s ON m.id = s.member_id AND s.coach_id = mc.coach_id
GROUP BY mc.coach_id, m.id, m.name, m.email, m.membership_type
""", ["members", "member_coach", "sessions"], "X29 J6")
def _export_members_coach(t):
    return rp.export(t, "members_coach")


@register("export_members_gym", """
SELECT m.gym_id, m.id AS member_id, m.name, m.email, m.membership_type, c.name AS coach_name,
       c.email AS coach_email, COUNT(s.id) AS total_sessions,
       COUNT(CASE WHEN lower(s.status) = 'completed' THEN 1 END) AS completed_sessions,
       MAX(s.session_date) AS last_session_date
FROM members m LEFT JOIN member_coach mc ON m.id = mc.member_id LEFT JOIN coaches c ON mc.coach_id = c.id
LEFT JOIN sessions s ON m.id = s.member_id
GROUP BY m.gym_id, m.id, m.name, m.email, m.membership_type, mc.coach_id, c.name, c.email
""", ["members", "member_coach", "coaches", "sessions"], "X29 J4 J8")
def _export_members_gym(t):
    return rp.export(t, "members_gym")


@register("export_coaches_gym", f"""
WITH am AS (SELECT mc.coach_id, COUNT(DISTINCT m.id) AS assigned_members
            FROM member_coach mc JOIN members m ON mc.member_id = m.id GROUP BY 1),
ss AS (SELECT coach_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions
       FROM sessions GROUP BY 1)
SELECT c.gym_id, c.id AS coach_id, c.name, c.email, c.specialization, c.status,
       COALESCE(am.assigned_members, 0) AS assigned_members, COALESCE(ss.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(ss.completed_sessions, 0) AS BIGINT) AS completed_sessions
FROM coaches c LEFT JOIN am ON am.coach_id = c.id LEFT JOIN ss ON ss.coach_id = c.id
""", ["coaches", "member_coach", "members", "sessions"], "X29 J8 D2")
def _export_coaches_gym(t):
    return rp.export(t, "coaches_gym")


@register("export_nutrition_coach", """
SELECT mc.coach_id, m.name AS member_name, m.email AS member_email, nl.created_at AS entry_date, nl.meal_type,
       COALESCE(nl.custom_food_name, fi.name) AS food_name, nl.quantity, nl.unit,
       nl.total_calories AS calories, nl.total_protein AS protein, nl.total_carbs AS carbs, nl.total_fat AS fat
FROM nutrition_logs nl JOIN members m ON nl.member_id = m.id JOIN member_coach mc ON m.id = mc.member_id
LEFT JOIN food_items fi ON nl.food_item_id = fi.id
""", ["nutrition_logs", "members", "member_coach", "food_items"], "X29 J21 P14")
def _export_nutrition_coach(t):
    return rp.export(t, "nutrition_coach")


@register("export_dashboard_gym", """
SELECT gym_id, member_name, member_email, coach_name, coach_email, session_date, session_time, workout_type,
       status, duration
FROM (SELECT s.gym_id, m.name AS member_name, m.email AS member_email, c.name AS coach_name,
             c.email AS coach_email, s.session_date, s.session_time, s.notes AS workout_type, s.status,
             s.duration,
             row_number() OVER (PARTITION BY s.gym_id ORDER BY s.session_date DESC, s.session_time DESC,
                                s.id DESC) AS rn
      FROM sessions s JOIN members m ON s.member_id = m.id JOIN coaches c ON s.coach_id = c.id) x
WHERE rn <= 50
""", ["sessions", "members", "coaches"], "X29 W2 O3")
def _export_dashboard_gym(t):
    return rp.export(t, "dashboard_gym")
