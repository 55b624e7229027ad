"""Registered queries: keyed writes on stored tables, interval overlap, session rows, deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.operators import bookings as bk
from gymlake.operators import intervals as iv
from gymlake.operators import meal_plans as mp
from gymlake.operators import nutrition as nu
from gymlake.operators import scheduling as sc
from gymlake.operators import upserts as up
from gymlake.plans import reports as rp
from gymlake.plans.catalog import register
from gymlake.plans.q_nutrition import _FOOD_ROWS
from gymlake.plans.q_scheduling import _VALIDATE
from gymlake.sources.keyed import KeyedTable, fresh_path

DAYS = ("2024-01-08", "2024-01-14")
SLOT = ["user_id", "user_type", "slot_date", "hour"]


@register("stored_slots", """
WITH req AS (
  SELECT user_id, user_type, CAST(d AS DATE) AS slot_date, CAST(h AS INTEGER) AS hour, is_available, seq, 1 AS prio
  FROM bulk_requests,
       LATERAL (SELECT unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d) dd,
       LATERAL (SELECT unnest(range(start_hour, end_hour + 1)) AS h) hh
  WHERE h BETWEEN 0 AND 23),
allw AS (
  SELECT user_id, user_type, slot_date, hour, is_available, seq, 0 AS prio FROM availability_slots
  UNION ALL SELECT * FROM req),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, user_type, slot_date, hour ORDER BY prio DESC, seq DESC) AS rn
                 FROM allw) t WHERE rn = 1)
SELECT k.user_id, k.user_type, k.slot_date, k.hour, k.is_available, k.seq FROM kept k
WHERE NOT EXISTS (SELECT 1 FROM slot_delete_requests d WHERE d.user_id = k.user_id AND d.user_type = k.user_type
                    AND d.slot_date = k.slot_date AND d.hour = k.hour)
""", ["availability_slots", "bulk_requests", "slot_delete_requests"], "X10 X11 X13 W5")
def _stored_slots(t):
    base = t.availability_slots.select(*SLOT, "is_available", "seq")
    table = KeyedTable.create(base, fresh_path(t.spark, "slots"), SLOT)
    table.upsert(sc.bulk_requests_to_slots(t.bulk_requests), ["seq"], keep_first=())
    table.delete(t.slot_delete_requests)
    return table.read()


_PLAN_UPDATES = """
access AS (SELECT DISTINCT p.id AS plan_id, mc.coach_id FROM nutrition_plans p JOIN member_coach mc ON mc.member_id = p.member_id),
upd AS (
  SELECT u.* FROM plan_update_requests u JOIN access a ON a.plan_id = u.plan_id AND a.coach_id = u.coach_id
  WHERE u.plan_name <> '' AND u.daily_calories <> 0 AND u.daily_protein <> 0 AND u.daily_carbs <> 0 AND u.daily_fat <> 0
  QUALIFY row_number() OVER (PARTITION BY u.plan_id ORDER BY u.seq DESC) = 1)"""


@register("stored_plans", f"""
WITH {_PLAN_UPDATES}
SELECT p.id, p.member_id, COALESCE(u.plan_name, p.plan_name) AS plan_name, COALESCE(u.daily_calories, p.daily_calories) AS daily_calories,
       COALESCE(u.daily_protein, p.daily_protein) AS daily_protein, COALESCE(u.daily_carbs, p.daily_carbs) AS daily_carbs,
       COALESCE(u.daily_fat, p.daily_fat) AS daily_fat
FROM nutrition_plans p LEFT JOIN upd u ON u.plan_id = p.id
WHERE NOT EXISTS (SELECT 1 FROM plan_delete_requests d JOIN access a ON a.plan_id = d.plan_id AND a.coach_id = d.coach_id
                  WHERE d.plan_id = p.id)
""", ["nutrition_plans", "member_coach", "plan_update_requests", "plan_delete_requests"], "X13 X19 J9")
def _stored_plans(t):
    base = t.nutrition_plans.select("id", "member_id", *mp.PLAN_FIELDS)
    table = KeyedTable.create(base, fresh_path(t.spark, "plans"), "id")
    table.patch(mp.plan_updates(t.plan_update_requests, base, t.member_coach))
    table.delete(mp.allowed_plan_requests(t.plan_delete_requests, base, t.member_coach).select(F.col("plan_id").alias("id")))
    return table.read()


@register("delete_messages", """
SELECT m.id, m.conv_id, m.sender_id, m.sender_type FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM message_delete_requests d
                  WHERE d.id = m.id AND d.sender_id = m.sender_id AND d.sender_type = m.sender_type)
""", ["messages", "message_delete_requests"], "X13")
def _delete_messages(t):
    return (up.guarded_delete(t.messages, t.message_delete_requests, "id", ["sender_id", "sender_type"])
            .select("id", "conv_id", "sender_id", "sender_type"))


_REPEATED = _VALIDATE.replace("FROM booking_requests", "FROM repeated_booking_requests")


@register("validate_repeated_bookings", f"""
WITH RECURSIVE {_REPEATED}
SELECT *, reason IS NULL AS accepted FROM v
""", ["repeated_booking_requests", "members", "coaches", "member_coach", "sessions"], "X7 J9 J11 J13")
def _validate_repeated_bookings(t):
    return bk.validate_bookings(t.repeated_booking_requests, t.members, t.coaches, t.member_coach, t.sessions)


@register("booked_sessions", f"""
WITH RECURSIVE {_VALIDATE}
SELECT v.request_id, c.gym_id, v.coach_id, v.member_id, v.session_date, v.session_time, v.duration, 'Scheduled' AS status,
       'Workout Type: ' || w.workout_type
         || CASE WHEN w.n_exercises > 0 THEN chr(10) || 'Exercises:' || chr(10)
              || array_to_string(list_transform(range(1, w.n_exercises + 1), lambda i: i || '. Exercise ' || i || chr(10)), '') ELSE '' END
         || CASE WHEN w.notes <> '' THEN chr(10) || w.notes ELSE '' END AS notes
FROM v JOIN workout_requests w ON w.request_id = v.request_id JOIN coaches c ON c.id = v.coach_id
WHERE v.reason IS NULL AND c.gym_id IS NOT NULL
""", ["booking_requests", "workout_requests", "members", "coaches", "member_coach", "sessions"], "X41 F4")
def _booked_sessions(t):
    checked = bk.validate_bookings(t.booking_requests, t.members, t.coaches, t.member_coach, t.sessions)
    exercises = F.expr("IF(n_exercises > 0, transform(sequence(1, CAST(n_exercises AS INT)), i -> concat('Exercise ', i)), "
                       "CAST(array() AS ARRAY<STRING>))")
    details = t.workout_requests.select("request_id", "workout_type", exercises.alias("exercises"), "notes")
    return bk.session_rows(checked.filter("accepted").join(details, "request_id"), t.coaches)


@register("day_schedule", f"""
WITH days AS (SELECT g.id AS gym_id, CAST(d AS DATE) AS session_date FROM gyms g,
                (SELECT unnest(generate_series(DATE '{DAYS[0]}', DATE '{DAYS[1]}', INTERVAL 1 DAY)) AS d) dd)
SELECT d.gym_id, d.session_date,
       CAST(CASE WHEN s.id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY d.gym_id, d.session_date ORDER BY s.session_time, s.id) END
            AS INTEGER) AS place,
       s.id AS session_id, s.session_time, s.status, m.name AS member_name, c.name AS coach_name
FROM days d LEFT JOIN sessions s ON s.gym_id = d.gym_id AND s.session_date = d.session_date
LEFT JOIN members m ON m.id = s.member_id LEFT JOIN coaches c ON c.id = s.coach_id
""", ["gyms", "sessions", "members", "coaches"], "X39")
def _day_schedule(t):
    return rp.day_schedule(t, *DAYS)


@register("latest_meal_analyses", f"""
WITH {_FOOD_ROWS},
day AS (SELECT member_id, log_date AS analysis_date, ROUND(SUM(food.calories), 4) AS total_calories,
               ROUND(SUM(food.protein), 4) AS total_protein, ROUND(SUM(food.carbs), 4) AS total_carbs,
               ROUND(SUM(food.fat), 4) AS total_fat, COUNT(*) AS foods
        FROM rows GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY member_id ORDER BY analysis_date DESC) AS INTEGER) AS rank_in_group
FROM day QUALIFY rank_in_group <= 7
""", ["detected_meals"], "W2 X38")
def _latest_meal_analyses(t):
    return nu.latest_analyses(t.detected_meals)


_MINUTE = ("(CAST(epoch(CAST(session_date AS TIMESTAMP)) AS BIGINT) // 60 + CAST(split_part(session_time, ':', 1) AS BIGINT) * 60"
           " + CAST(split_part(session_time, ':', 2) AS BIGINT))")
_ACTIVE = f"act AS (SELECT *, {_MINUTE} AS s, {_MINUTE} + duration AS e FROM sessions WHERE lower(status) <> 'cancelled')"


@register("overlap_check", f"""
WITH {_ACTIVE},
r AS (SELECT *, {_MINUTE} AS s, {_MINUTE} + duration AS e FROM booking_requests)
SELECT request_id, coach_id, member_id, session_date, session_time, duration,
       EXISTS (SELECT 1 FROM act a WHERE a.coach_id = r.coach_id AND r.s < a.e AND r.e > a.s) AS coach_busy,
       EXISTS (SELECT 1 FROM act a WHERE a.member_id = r.member_id AND r.s < a.e AND r.e > a.s) AS member_busy
FROM r
""", ["booking_requests", "sessions"], "J10")
def _overlap_check(t):
    return iv.overlap_check(t.booking_requests, t.sessions)


@register("double_bookings", f"""
WITH {_ACTIVE}
SELECT a.member_id, a.id AS first_id, b.id AS second_id
FROM act a JOIN act b ON a.member_id = b.member_id AND a.id < b.id AND a.s < b.e AND a.e > b.s
""", ["sessions"], "J10")
def _double_bookings(t):
    return iv.double_bookings(t.sessions, "member_id")


@register("coach_peak_load", f"""
WITH {_ACTIVE},
d AS (SELECT coach_id, unnest(range(s // 1440, (e - 1) // 1440 + 1)) AS day, s, e FROM act WHERE s < e),
p AS (SELECT coach_id, day, greatest(s - day * 1440, 0) AS a, least(e - day * 1440, 1440) AS b FROM d),
n AS (SELECT x.coach_id, x.day, x.a AS minute, COUNT(*) AS load
      FROM (SELECT DISTINCT coach_id, day, a FROM p) x JOIN p ON p.coach_id = x.coach_id AND p.day = x.day AND p.a <= x.a AND p.b > x.a
      GROUP BY 1, 2, 3)
SELECT coach_id, CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS DATE) AS date, load AS peak, CAST(minute AS INTEGER) AS at_minute
FROM n QUALIFY row_number() OVER (PARTITION BY coach_id, day ORDER BY load DESC, minute) = 1
""", ["sessions"], "J10")
def _coach_peak_load(t):
    return iv.peak_load(t.sessions, "coach_id")
