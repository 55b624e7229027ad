"""Registered queries: sessions, membership and coach reporting (A1-A14, W1-W3, J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.functions.notes import parse_notes_lenient, parse_notes_sql, parse_notes_strict
from gymlake.operators import attendance as at
from gymlake.operators import filters as flt
from gymlake.plans.catalog import register
from gymlake.sources.fixtures import SESSION_AS_OF

AS_OF = SESSION_AS_OF
D = f"DATE '{AS_OF}'"
COMPLETED = "CASE WHEN lower(status) = 'completed' THEN 1 ELSE 0 END"
CANCELLED = "CASE WHEN lower(status) = 'cancelled' THEN 1 ELSE 0 END"


@register("coach_analytics", f"""
SELECT c.gym_id, c.id AS coach_id, c.name AS coach_name, c.email AS coach_email, c.specialization,
       COUNT(s.id) AS total_sessions,
       COUNT(CASE WHEN lower(s.status) = 'completed' THEN 1 END) AS completed_sessions,
       COUNT(DISTINCT s.member_id) AS unique_members,
       ROUND(CAST(COUNT(CASE WHEN lower(s.status) = 'completed' THEN 1 END) AS DOUBLE) * 100.0
             / NULLIF(COUNT(s.id), 0), 2) AS completion_rate
FROM coaches c LEFT JOIN sessions s ON c.id = s.coach_id
GROUP BY c.gym_id, c.id, c.name, c.email, c.specialization
""", ["coaches", "sessions"], "A14 P1 J5 O6")
def _coach_analytics(t):
    return at.coach_analytics(t.coaches, t.sessions)


@register("session_stats", f"""
SELECT member_id, COUNT(*) AS total_sessions,
       CAST(SUM({COMPLETED}) AS BIGINT) AS completed_sessions,
       CAST(SUM({CANCELLED}) AS BIGINT) AS cancelled_sessions,
       CAST(SUM(CASE WHEN session_date >= {D} THEN 1 ELSE 0 END) AS BIGINT) AS upcoming_sessions,
       CAST(SUM(CASE WHEN session_date >= {D} - 7 THEN 1 ELSE 0 END) AS BIGINT) AS week_sessions,
       CAST(SUM(CASE WHEN session_date >= {D} - 7 AND lower(status) = 'completed' THEN 1 ELSE 0 END)
            AS BIGINT) AS week_completed_sessions,
       CAST(COALESCE(round_even(
            CAST(SUM(CASE WHEN session_date >= {D} - 7 AND lower(status) = 'completed' THEN 1 ELSE 0 END)
                 AS DOUBLE) * 100.0
            / NULLIF(SUM(CASE WHEN session_date >= {D} - 7 THEN 1 ELSE 0 END), 0), 0), 0) AS INTEGER)
         AS week_progress
FROM sessions GROUP BY member_id
""", ["sessions"], "A1 A8")
def _session_stats(t):
    return at.session_stats(t.sessions, "member_id", AS_OF)


@register("member_overview", f"""
WITH per AS (
  SELECT member_id, COUNT(*) AS total_sessions, SUM({COMPLETED}) AS completed_sessions,
         SUM({CANCELLED}) AS cancelled_sessions,
         MAX(CASE WHEN lower(status) = 'completed' THEN session_date END) AS last_session
  FROM sessions GROUP BY member_id)
SELECT mc.coach_id, m.id AS member_id, m.name, m.email, m.membership_type, m.gym_id,
       COALESCE(p.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(p.completed_sessions, 0) AS BIGINT) AS completed_sessions,
       CAST(COALESCE(p.cancelled_sessions, 0) AS BIGINT) AS cancelled_sessions,
       p.last_session,
       COALESCE(round_even(CAST(p.completed_sessions AS DOUBLE) * 100.0
                           / NULLIF(p.total_sessions, 0), 1), 0.0) AS attendance_rate
FROM member_coach mc JOIN members m ON m.id = mc.member_id
LEFT JOIN per p ON p.member_id = m.id
""", ["member_coach", "members", "sessions"], "A2 A5 A8 J5 J7")
def _member_overview(t):
    return at.member_overview(t.members, t.member_coach, t.sessions)


@register("coach_overview", f"""
SELECT c.id AS coach_id, c.gym_id, c.name, c.email, c.specialization, c.status,
       COUNT(DISTINCT mc.member_id) AS total_members,
       COUNT(DISTINCT s.id) AS total_sessions,
       COUNT(DISTINCT CASE WHEN lower(s.status) = 'completed' THEN s.id END) AS completed_sessions,
       COALESCE(round_even(CAST(COUNT(DISTINCT CASE WHEN lower(s.status) = 'completed' THEN s.id END)
                                AS DOUBLE) * 100.0 / NULLIF(COUNT(DISTINCT s.id), 0), 1), 0.0)
         AS completion_rate
FROM coaches c
LEFT JOIN member_coach mc ON c.id = mc.coach_id
LEFT JOIN sessions s ON c.id = s.coach_id
GROUP BY c.id, c.gym_id, c.name, c.email, c.specialization, c.status
""", ["coaches", "member_coach", "sessions"], "A3 J8 A8")
def _coach_overview(t):
    return at.coach_overview(t.coaches, t.member_coach, t.sessions)


@register("coach_dashboard", f"""
SELECT c.id AS coach_id, c.gym_id, c.name,
       COUNT(DISTINCT mc.member_id) AS total_members,
       COUNT(DISTINCT s.id) AS total_sessions,
       COUNT(DISTINCT CASE WHEN lower(s.status) = 'completed' THEN s.id END) AS completed_sessions,
       COUNT(DISTINCT CASE WHEN s.session_date >= {D} THEN s.id END) AS upcoming_sessions,
       COUNT(DISTINCT CASE WHEN s.session_date >= {D} - 7 THEN s.id END) AS week_sessions,
       COUNT(DISTINCT CASE WHEN lower(s.status) = 'completed' AND s.session_date >= {D} - 7
                      THEN s.id END) AS week_completed_sessions,
       CASE WHEN COUNT(DISTINCT s.id) = 0 THEN 85.0
            ELSE least(100.0, greatest(60.0, round_even(
                 CAST(COUNT(DISTINCT CASE WHEN lower(s.status) = 'completed' THEN s.id END) AS DOUBLE)
                 * 100.0 / COUNT(DISTINCT s.id), 6) + 20.0)) END AS performance_rating
FROM coaches c
LEFT JOIN member_coach mc ON c.id = mc.coach_id
LEFT JOIN sessions s ON c.id = s.coach_id
GROUP BY c.id, c.gym_id, c.name
""", ["coaches", "member_coach", "sessions"], "A4 A9 A5")
def _coach_dashboard(t):
    return at.coach_dashboard(t.coaches, t.member_coach, t.sessions, AS_OF)


@register("gym_dashboard", f"""
SELECT g.id AS gym_id, g.name AS gym_name,
       (SELECT COUNT(*) FROM members m WHERE m.gym_id = g.id) AS total_members,
       (SELECT COUNT(*) FROM coaches c WHERE c.gym_id = g.id AND c.status = 'Active') AS active_coaches,
       (SELECT COUNT(*) FROM sessions s WHERE s.gym_id = g.id AND s.session_date = {D}) AS today_sessions,
       ROUND(COALESCE((SELECT SUM(CASE m.membership_type WHEN 'Basic' THEN 50.0
                                   WHEN 'Premium' THEN 100.0 WHEN 'VIP' THEN 150.0 END)
                       FROM members m WHERE m.gym_id = g.id), 0), 2)::DOUBLE AS monthly_revenue
FROM gyms g
""", ["gyms", "members", "coaches", "sessions"], "A6 A7")
def _gym_dashboard(t):
    return at.gym_dashboard(t.gyms, t.members, t.coaches, t.sessions, AS_OF)


@register("monthly_revenue", """
SELECT gym_id, membership_type, COUNT(*) AS members,
       ROUND(COALESCE(SUM(CASE membership_type WHEN 'Basic' THEN 50.0 WHEN 'Premium' THEN 100.0
                          WHEN 'VIP' THEN 150.0 END), 0), 2)::DOUBLE AS revenue
FROM members GROUP BY ROLLUP (gym_id, membership_type)
HAVING gym_id IS NOT NULL
""", ["members"], "A7")
def _monthly_revenue(t):
    return at.monthly_revenue(t.members)


@register("membership_stats", f"""
SELECT gym_id, membership_type, COUNT(*) AS count,
       CAST(SUM(CASE WHEN join_date >= {D} - 30 THEN 1 ELSE 0 END) AS BIGINT) AS new_members
FROM members GROUP BY gym_id, membership_type
""", ["members"], "A13")
def _membership_stats(t):
    return at.membership_stats(t.members, AS_OF)


@register("revenue_stats", """
SELECT gym_id,
       ROUND(SUM(CASE membership_type WHEN 'Basic' THEN 50.0 WHEN 'Premium' THEN 100.0
                 WHEN 'VIP' THEN 150.0 END), 2)::DOUBLE AS monthly_revenue,
       COUNT(CASE WHEN membership_type = 'Basic' THEN 1 END) AS basic_members,
       COUNT(CASE WHEN membership_type = 'Premium' THEN 1 END) AS premium_members,
       COUNT(CASE WHEN membership_type = 'VIP' THEN 1 END) AS vip_members
FROM members GROUP BY gym_id
""", ["members"], "A7 X28")
def _revenue_stats(t):
    return at.revenue_stats(t.members)


@register("gym_session_report", f"""
SELECT gym_id, COUNT(*) AS total_sessions,
       CAST(SUM({COMPLETED}) AS BIGINT) AS completed_sessions,
       CAST(SUM({CANCELLED}) AS BIGINT) AS cancelled_sessions,
       COUNT(DISTINCT member_id) AS active_members, COUNT(DISTINCT coach_id) AS active_coaches
FROM sessions WHERE session_date >= {D} - 30
GROUP BY gym_id
""", ["sessions"], "A14")
def _gym_session_report(t):
    return at.gym_session_report(t.sessions, AS_OF)


@register("coach_performance", f"""
SELECT c.gym_id, c.id AS coach_id, c.name AS coach_name,
       COUNT(s.id) AS total_sessions,
       CAST(COALESCE(SUM(CASE WHEN lower(s.status) = 'completed' THEN 1 ELSE 0 END), 0) AS BIGINT)
         AS completed_sessions,
       COUNT(DISTINCT s.member_id) AS unique_members
FROM coaches c
LEFT JOIN sessions s ON c.id = s.coach_id AND s.session_date >= {D} - 30
GROUP BY c.gym_id, c.id, c.name
""", ["coaches", "sessions"], "A14 P11 J6")
def _coach_performance(t):
    return at.coach_performance(t.coaches, t.sessions, AS_OF)


_TYPE_SQL = "trim(split_part(string_split(s.notes, 'Workout Type:')[-1], chr(10), 1))"


@register("workout_distribution", f"""
SELECT mc.coach_id, {_TYPE_SQL} AS workout_type, COUNT(*) AS count
FROM sessions s JOIN member_coach mc ON s.member_id = mc.member_id
WHERE s.notes ILIKE '%Workout Type:%' AND s.session_date >= {D} - 30
GROUP BY 1, 2
""", ["sessions", "member_coach"], "A11 F3 J7")
def _workout_distribution(t):
    return at.workout_distribution(t.sessions, t.member_coach, "month", AS_OF)


@register("common_workout", f"""
SELECT coach_id, workout_type, count FROM (
  SELECT mc.coach_id, {_TYPE_SQL} AS workout_type, COUNT(*) AS count,
         row_number() OVER (PARTITION BY mc.coach_id ORDER BY COUNT(*) DESC,
                            {_TYPE_SQL}) AS rn
  FROM sessions s JOIN member_coach mc ON s.member_id = mc.member_id
  WHERE s.notes ILIKE '%Workout Type:%'
  GROUP BY 1, 2) t
WHERE rn = 1
""", ["sessions", "member_coach"], "A10 W3")
def _common_workout(t):
    return at.common_workout(at.workout_distribution(t.sessions, t.member_coach))


@register("session_history", f"""
SELECT mc.coach_id, s.session_date, COUNT(*) AS count, strftime(s.session_date, '%Y-%m-%d') AS date
FROM sessions s JOIN member_coach mc ON s.member_id = mc.member_id
WHERE s.session_date >= {D} - 7
GROUP BY 1, 2
""", ["sessions", "member_coach"], "A12 P3")
def _session_history(t):
    return at.session_history(t.sessions, t.member_coach, "week", AS_OF)


@register("coach_progress_stats", f"""
SELECT mc.coach_id, COUNT(*) AS total_sessions,
       CAST(SUM({COMPLETED.replace('status', 's.status')}) AS BIGINT) AS completed_sessions,
       CAST(SUM({CANCELLED.replace('status', 's.status')}) AS BIGINT) AS cancelled_sessions,
       CAST(COALESCE(round_even(CAST(SUM({COMPLETED.replace('status', 's.status')}) AS DOUBLE) * 100.0
            / NULLIF(COUNT(*), 0), 0), 0) AS INTEGER) AS attendance_rate
FROM sessions s JOIN member_coach mc ON s.member_id = mc.member_id
WHERE s.session_date >= {D} - 90
GROUP BY mc.coach_id
""", ["sessions", "member_coach"], "A1 A8 X25")
def _coach_progress_stats(t):
    return at.coach_progress_stats(t.sessions, t.member_coach, "quarter", AS_OF)


@register("streaks", f"""
WITH d AS (SELECT DISTINCT member_id, session_date FROM sessions
           WHERE lower(status) = 'completed' AND session_date <= {D}),
g AS (SELECT member_id, session_date,
             session_date - CAST(row_number() OVER (PARTITION BY member_id ORDER BY session_date)
                                 AS INTEGER) AS grp FROM d),
r AS (SELECT member_id, grp, COUNT(*) AS run_len, MAX(session_date) AS run_end
      FROM g GROUP BY member_id, grp)
SELECT member_id, MAX(run_len) AS longest_streak,
       COALESCE(MAX(CASE WHEN run_end >= {D} - 1 THEN run_len END), 0) AS current_streak,
       CAST(SUM(run_len) AS BIGINT) AS active_days
FROM r GROUP BY member_id
""", ["sessions"], "W1")
def _streaks(t):
    return at.streaks(t.sessions, AS_OF)


@register("latest_sessions", """
SELECT member_id, id, session_date, session_time, status, rank_in_group FROM (
  SELECT member_id, id, session_date, session_time, status,
         CAST(row_number() OVER (PARTITION BY member_id
                            ORDER BY session_date DESC, session_time DESC, id DESC) AS INTEGER) AS rank_in_group
  FROM sessions) t
WHERE rank_in_group <= 5
""", ["sessions"], "W2 O3")
def _latest_sessions(t):
    s = t.sessions.select("member_id", "id", "session_date", "session_time", "status")
    return at.latest_n(s, "member_id", [F.desc("session_date"), F.desc("session_time"),
                                        F.desc("id")], 5)


@register("first_coach", """
SELECT member_id, coach_id, assigned_date FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY assigned_date, coach_id) AS rn
  FROM member_coach) t WHERE rn = 1
""", ["member_coach"], "W3")
def _first_coach(t):
    return at.first_by(t.member_coach, "member_id", [F.col("assigned_date"), F.col("coach_id")])


@register("gym_sessions", f"""
SELECT s.id, s.gym_id, s.session_date, s.session_time, s.duration, s.status,
       m.name AS member_name, c.name AS coach_name,
       CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 THEN
         CASE WHEN string_split(s.notes, chr(10))[1] LIKE '%Workout Type:%'
              THEN regexp_replace(string_split(string_split(s.notes, chr(10))[1], 'Workout Type:')[2],
                                  '^\\s+|\\s+$', '', 'g')
              ELSE replace(string_split(s.notes, chr(10))[1], ' Workout:', '') END
       ELSE 'Custom' END AS workout_type,
       CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 THEN
         array_to_string(list_filter(list_transform(string_split(s.notes, chr(10))[2:],
                          lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0), '|')
       ELSE '' END AS exercises
FROM sessions s JOIN members m ON m.id = s.member_id JOIN coaches c ON c.id = s.coach_id
WHERE s.session_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
  AND lower(s.status) <> 'cancelled'
""", ["sessions", "members", "coaches"], "J3 F2 P5 P10 X32")
def _gym_sessions(t):
    s = flt.active_sessions(flt.between_dates(t.sessions, "session_date", "2024-01-10", "2024-01-20"))
    j = at.gym_sessions(s, t.members, t.coaches)
    p = parse_notes_lenient("notes")
    return j.select("id", "gym_id", "session_date", "session_time", "duration", "status",
                    "member_name", "coach_name", p.workout_type.alias("workout_type"),
                    F.array_join(p.exercises, "|").alias("exercises"))


@register("coach_sessions", f"""
SELECT s.id, s.coach_id, s.member_id, m.name AS member_name, s.session_date, s.session_time,
       CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0
                 AND string_split(s.notes, chr(10))[1] LIKE '%Workout Type:%'
            THEN regexp_replace(string_split(string_split(s.notes, chr(10))[1], 'Workout Type:')[2],
                                '^\\s+|\\s+$', '', 'g')
            ELSE 'Custom' END AS workout_type,
       CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 THEN
         array_to_string(list_filter(list_transform(string_split(s.notes, chr(10))[2:],
                          lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                          lambda x: regexp_matches(x, '^[0-9]')), '|')
       ELSE '' END AS exercises
FROM sessions s JOIN members m ON m.id = s.member_id
WHERE s.session_date >= {D} - 7 AND (m.name ILIKE '%00%' OR m.email ILIKE '%00%')
""", ["sessions", "members"], "X32 F1 P3 P6 J1")
def _coach_sessions(t):
    s = flt.date_range(t.sessions, "session_date", "week", AS_OF)
    j = flt.search(at.sessions_with_member(s, t.members), "00", ["member_name", "member_email"])
    p = parse_notes_strict("notes")
    return j.select("id", "coach_id", "member_id", "member_name", "session_date", "session_time",
                    p.workout_type.alias("workout_type"),
                    F.array_join(p.exercises, "|").alias("exercises"))


@register("member_session_page", """
WITH p AS (
  SELECT s.id, s.member_id, c.name AS coach_name, g.name AS gym_name,
         CASE WHEN s.notes ILIKE '%Workout Type:%'
              THEN trim(split_part(string_split(s.notes, 'Workout Type:')[-1], chr(10), 1))
              ELSE 'General Training' END AS workout_type,
         CASE WHEN s.notes ILIKE '%Exercises:%'
              THEN trim(split_part(string_split(s.notes, 'Exercises:')[-1], chr(10), 1))
              ELSE 'No exercises specified' END AS exercises_text,
         CAST(row_number() OVER (PARTITION BY s.member_id ORDER BY s.session_date DESC,
                            s.session_time DESC, s.id DESC) AS INTEGER) AS row_in_group,
         COUNT(*) OVER (PARTITION BY s.member_id) AS total
  FROM sessions s LEFT JOIN coaches c ON s.coach_id = c.id LEFT JOIN gyms g ON s.gym_id = g.id)
SELECT *, 2 AS page, total > 40 AS has_more, CAST(ceil(total / 20.0) AS INTEGER) AS total_pages
FROM p WHERE row_in_group > 20 AND row_in_group <= 40
""", ["sessions", "coaches", "gyms"], "X36 F3 O4 A23 J6")
def _member_session_page(t):
    from gymlake.operators.ordering import paginate
    # the page is cut before the left joins, and totals count the member column alone
    page = paginate(t.sessions, "member_id", [F.desc("session_date"), F.desc("session_time"), F.desc("id")],
                    page=2, limit=20, counted=t.sessions.select("member_id"))
    s = (page
         .join(t.coaches.select(F.col("id").alias("coach_id"), F.col("name").alias("coach_name")),
               "coach_id", "left")
         .join(t.gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name")),
               "gym_id", "left"))
    p = parse_notes_sql("notes")
    return s.select("id", "member_id", "coach_name", "gym_name", p.workout_type.alias("workout_type"),
                    p.exercises_text.alias("exercises_text"), "row_in_group", "total", "page", "has_more",
                    "total_pages")
