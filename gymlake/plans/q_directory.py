"""Registered queries: directories, filters, suggestions, manual food logs and
recent-session dashboards (P2-P18, J23, J24, O5, F4, F8, X18, X37, S1, S6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gymlake.functions.notes import format_notes, parse_notes_strict
from gymlake.functions.text import cap_first
from gymlake.operators import attendance as at
from gymlake.operators import filters as flt
from gymlake.operators import nutrition as nu
from gymlake.operators.ordering import suggest
from gymlake.plans import reports as rp
from gymlake.plans.catalog import register
from gymlake.session import checkpoint_dir
from gymlake.sources.fixtures import SESSION_AS_OF
from gymlake.sources.sinks import append, read_report, write_report

AS_OF = SESSION_AS_OF
D = f"DATE '{AS_OF}'"
STRICT_TYPE = ("CASE WHEN s.notes IS NOT NULL AND length(s.notes) > 0 "
               "AND string_split(s.notes, chr(10))[1] LIKE '%Workout Type:%' "
               "THEN regexp_replace(string_split(string_split(s.notes, chr(10))[1], 'Workout Type:')[2], "
               "'^\\s+|\\s+$', '', 'g') ELSE 'Custom' END")


@register("coach_directory", """
SELECT c.id AS coach_id, c.gym_id, g.name AS gym_name, c.name, c.email, c.specialization, c.status
FROM coaches c JOIN gyms g ON g.id = c.gym_id
WHERE (c.name ILIKE '%0%' OR c.email ILIKE '%0%') AND c.specialization = 'Yoga'
""", ["coaches", "gyms"], "J23 P6 P7 P8 S1")
def _coach_directory(t):
    c = flt.opt_eq(flt.opt_eq(t.coaches, "specialization", "Yoga"), "status", "all")
    c = flt.search(c, "0", ["name", "email"])
    return at.coach_profile(c, t.gyms).select(F.col("id").alias("coach_id"), "gym_id", "gym_name", "name",
                                              "email", "specialization", "status")


@register("premium_member_sessions", f"""
SELECT m.id AS member_id, m.membership_type, COUNT(s.id) AS sessions
FROM members m LEFT JOIN sessions s ON s.member_id = m.id AND s.session_date >= {D}
WHERE m.membership_type IN ('Premium', 'VIP')
GROUP BY m.id, m.membership_type
""", ["members", "sessions"], "P17 P18 J5")
def _premium_member_sessions(t):
    m = flt.entitled(t.members)
    up = flt.upcoming(t.sessions, AS_OF).groupBy("member_id").agg(F.count(F.lit(1)).alias("sessions"))
    return (m.select(F.col("id").alias("member_id"), "membership_type").join(up, "member_id", "left")
            .select("member_id", "membership_type", F.coalesce("sessions", F.lit(0)).alias("sessions")))


@register("recent_month_sessions", f"""
SELECT s.id, s.member_id, s.coach_id, s.session_date,
       upper(substr(lower(s.status), 1, 1)) || substr(lower(s.status), 2) AS status_label,
       {STRICT_TYPE} AS workout_type
FROM sessions s
WHERE s.session_date BETWEEN {D} - INTERVAL 1 MONTH AND {D}
  AND s.id <> 0 AND s.member_id <> 0 AND s.coach_id <> 0 AND s.duration <> 0
  AND length(s.session_time) > 0 AND length(s.status) > 0 AND length(s.notes) > 0
""", ["sessions"], "P4 P13 F8 F1")
def _recent_month_sessions(t):
    s = flt.valid_sessions(flt.date_range_closed(t.sessions, "session_date", "month", AS_OF))
    p = parse_notes_strict("notes")
    return s.select("id", "member_id", "coach_id", "session_date",
                    cap_first(F.lower("status")).alias("status_label"), p.workout_type.alias("workout_type"))


@register("assigned_upcoming", f"""
SELECT mc.coach_id, mc.member_id, mc.assigned_date, m.name, s.id, s.session_date,
       'Workout Type: ' || {STRICT_TYPE} ||
       CASE WHEN len(list_filter(list_transform(string_split(COALESCE(s.notes, ''), chr(10))[2:],
                     lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                     lambda x: regexp_matches(x, '^[0-9]'))) > 0
            THEN chr(10) || 'Exercises:' || chr(10) ||
                 array_to_string(list_transform(list_filter(list_transform(
                     string_split(COALESCE(s.notes, ''), chr(10))[2:],
                     lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                     lambda x: regexp_matches(x, '^[0-9]')),
                     lambda e, i: CAST(i AS VARCHAR) || '. ' || e || chr(10)), '')
            ELSE '' END AS formatted_notes
FROM member_coach mc JOIN members m ON m.id = mc.member_id
JOIN sessions s ON s.member_id = mc.member_id AND s.coach_id = mc.coach_id
WHERE s.session_date >= {D}
""", ["member_coach", "members", "sessions"], "J24 J7 P18 F4 F1")
def _assigned_upcoming(t):
    cm = at.coach_members(t.member_coach, t.members)
    s = flt.upcoming(t.sessions, AS_OF).select("member_id", "coach_id", "id", "session_date", "notes")
    p = parse_notes_strict("notes")
    return (cm.join(s, ["member_id", "coach_id"])
            .select("coach_id", "member_id", "assigned_date", "name", "id", "session_date",
                    format_notes(p.workout_type, p.exercises, F.lit(None).cast("string"))
                    .alias("formatted_notes")))


@register("member_suggestions", """
SELECT id, name, email FROM members
WHERE name ILIKE '%Customer#00000012%' OR email ILIKE '%Customer#00000012%'
ORDER BY name, id LIMIT 5
""", ["members"], "O5 P6 O3")
def _member_suggestions(t):
    return suggest(t.members.select("id", "name", "email"), "Customer#00000012", ["name", "email"],
                   [F.col("name"), F.col("id")], 5)


@register("log_foods", """
WITH ok AS (
  SELECT member_id, log_date, total_calories, total_protein, total_carbs, total_fat
  FROM food_entries
  WHERE unit IN ('grams', 'ml', 'pieces', 'cups', 'tablespoons', 'serving')
    AND meal_type IN ('breakfast', 'lunch', 'dinner', 'snack') AND quantity > 0)
SELECT member_id, log_date AS analysis_date, COUNT(*) AS entries,
       CAST(SUM(total_calories) AS DECIMAL(18,2)) AS total_calories,
       CAST(SUM(total_protein) AS DECIMAL(18,2)) AS total_protein,
       CAST(SUM(total_carbs) AS DECIMAL(18,2)) AS total_carbs, CAST(SUM(total_fat) AS DECIMAL(18,2)) AS total_fat
FROM ok GROUP BY member_id, log_date
""", ["food_entries"], "X18")
def _log_foods(t):
    return nu.log_day_totals(t.food_entries)


@register("merge_day_totals", """
WITH stored AS (SELECT member_id, log_date, total_calories, total_protein, total_carbs, total_fat
                FROM nutrition_logs),
new AS (SELECT member_id, log_date, total_calories, total_protein, total_carbs, total_fat FROM food_entries
        WHERE unit IN ('grams', 'ml', 'pieces', 'cups', 'tablespoons', 'serving')
          AND meal_type IN ('breakfast', 'lunch', 'dinner', 'snack') AND quantity > 0)
SELECT member_id, log_date AS analysis_date, CAST(SUM(total_calories) AS DECIMAL(18,2)) AS total_calories,
       CAST(SUM(total_protein) AS DECIMAL(18,2)) AS total_protein,
       CAST(SUM(total_carbs) AS DECIMAL(18,2)) AS total_carbs, CAST(SUM(total_fat) AS DECIMAL(18,2)) AS total_fat
FROM (SELECT * FROM stored UNION ALL SELECT * FROM new) x GROUP BY member_id, log_date
""", ["nutrition_logs", "food_entries"], "A26 X18 S7")
def _merge_day_totals(t):
    # stored day totals live in an appended table, partitioned by month
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/day_totals/{uuid.uuid4().hex[:10]}"
    totals = nu.daily_nutrition(t.nutrition_logs).select(
        "member_id", F.col("log_date").alias("analysis_date"), *[F.col(m).alias(f"total_{m}") for m in nu.MACROS])
    append(totals.withColumn("month", F.date_format("analysis_date", "yyyy-MM")), path, "month")
    return nu.accumulate_day(t.spark.read.schema(totals.schema).parquet(path), nu.log_day_totals(t.food_entries))


@register("gym_recent_sessions", f"""
SELECT gym_id, id, member_name, coach_name, session_date, session_time, status_label, workout_type, rank_in_group
FROM (SELECT s.gym_id, s.id, m.name AS member_name, c.name AS coach_name, s.session_date, s.session_time,
             upper(substr(s.status, 1, 1)) || substr(s.status, 2) AS status_label, {STRICT_TYPE} AS workout_type,
             CAST(row_number() OVER (PARTITION BY s.gym_id ORDER BY s.session_date DESC, s.session_time DESC,
                                s.id DESC) AS INTEGER) AS rank_in_group
      FROM sessions s JOIN members m ON m.id = s.member_id JOIN coaches c ON c.id = s.coach_id) x
WHERE rank_in_group <= 5
""", ["sessions", "members", "coaches"], "X37 W2 F1 F8 J3")
def _gym_recent_sessions(t):
    # cut first: every session has its member and coach (foreign keys), so the five
    # latest per gym are the same before the joins
    top = at.latest_n(t.sessions, "gym_id", [F.desc("session_date"), F.desc("session_time"), F.desc("id")], 5)
    top = at.gym_sessions(top, t.members, t.coaches)
    p = parse_notes_strict("notes")
    return top.select("gym_id", "id", "member_name", "coach_name", "session_date", "session_time",
                      cap_first("status").alias("status_label"), p.workout_type.alias("workout_type"),
                      "rank_in_group")


@register("report_roundtrip", """
WITH am AS (SELECT mc.coach_id, COUNT(DISTINCT m.id) AS assigned_members
            FROM member_coach mc JOIN members m ON mc.member_id = m.id GROUP BY 1),
ss AS (SELECT coach_id, COUNT(*) AS total_sessions,
              SUM(CASE WHEN lower(status) = 'completed' THEN 1 ELSE 0 END) AS completed_sessions
       FROM sessions GROUP BY 1)
SELECT c.gym_id, c.id AS coach_id, c.name, c.email, c.specialization, c.status,
       COALESCE(am.assigned_members, 0) AS assigned_members, COALESCE(ss.total_sessions, 0) AS total_sessions,
       CAST(COALESCE(ss.completed_sessions, 0) AS BIGINT) AS completed_sessions
FROM coaches c LEFT JOIN am ON am.coach_id = c.id LEFT JOIN ss ON ss.coach_id = c.id
""", ["coaches", "member_coach", "members", "sessions"], "S6 S1 X29")
def _report_roundtrip(t):
    report = rp.export(t, "coaches_gym")
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/reports/coaches_gym-{uuid.uuid4().hex[:10]}"
    write_report(report, path, "csv")
    return read_report(t.spark, path, report.schema)


@register("notes_roundtrip", """
SELECT s.gym_id, m.name AS member_name, m.email AS member_email, c.name AS coach_name, c.email AS coach_email,
       s.session_date, s.session_time, s.notes AS workout_type, s.status, s.duration, s.notes, s.created_at
FROM sessions s JOIN members m ON m.id = s.member_id JOIN coaches c ON c.id = s.coach_id
""", ["sessions", "members", "coaches"], "S6 X29 J3")
def _notes_roundtrip(t):
    # session notes hold line breaks: the report must come back with them
    report = rp.export(t, "sessions_gym")
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/reports/sessions_gym-{uuid.uuid4().hex[:10]}"
    write_report(report, path, "csv")
    return read_report(t.spark, path, report.schema)
