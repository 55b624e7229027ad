"""Registered queries: availability, slot matching, grids, bookings, billing, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.operators import billing as bl
from gymlake.operators import bookings as bk
from gymlake.operators import hour_masks as hm
from gymlake.operators import scheduling as sc
from gymlake.operators import upserts as up
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import q
from gymlake.sources.fixtures import SESSION_NOW

NOW = SESSION_NOW
NOW_TS = f"TIMESTAMP '{NOW}'"
TODAY = f"CAST({NOW_TS} AS DATE)"
WEEK_START = "2024-01-22"
DOW = ("CASE {0} WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2 "
       "WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 WHEN 'Sunday' THEN 6 END")
HOUR = "TRY_CAST(split_part({0}, ':', 1) AS INTEGER)"

_WEEKLY = f"""
w AS (SELECT user_id, user_type, day_of_week, {DOW.format('day_of_week')} AS dow,
             {HOUR.format('start_time')} AS sh, {HOUR.format('end_time')} AS eh
      FROM free_days WHERE is_available),
slots AS (SELECT user_id, user_type, day_of_week, dow,
                 CAST(unnest(range(sh, least(eh, 24))) AS INTEGER) AS hour
          FROM w WHERE sh IS NOT NULL AND eh IS NOT NULL AND eh > sh)"""

_PREFS = f"""
prefs AS (
  SELECT user_id, user_type,
         COALESCE(list_distinct(list_filter(list_transform(
             CASE WHEN json_valid(preferred_time_slots)
                  THEN from_json(preferred_time_slots, '["VARCHAR"]') END,
             lambda s: {HOUR.format('s')}), lambda h: h IS NOT NULL)), []) AS pref_hours
  FROM user_preferences)"""

_SESSION_START = ("CAST(session_date AS TIMESTAMP) + (CAST(split_part(session_time, ':', 1) AS INTEGER) * 60"
                  " + CAST(split_part(session_time, ':', 2) AS INTEGER)) * INTERVAL 1 MINUTE")


@register("expand_weekly", f"""
WITH {_WEEKLY}
SELECT * FROM slots
""", ["free_days"], "X1 F15 F12")
def _expand_weekly(t):
    return sc.expand_weekly(t.free_days)


@register("match_slots", f"""
WITH {_WEEKLY}, {_PREFS},
pairs AS (SELECT DISTINCT coach_id, member_id FROM member_coach),
common AS (
  SELECT p.coach_id, p.member_id, ms.dow, ms.day_of_week, ms.hour
  FROM pairs p
  JOIN slots ms ON ms.user_id = p.member_id AND ms.user_type = 'member'
  JOIN slots cs ON cs.user_id = p.coach_id AND cs.user_type = 'coach'
                AND cs.dow = ms.dow AND cs.hour = ms.hour),
c0 AS (
  SELECT *, CAST({TODAY} + CAST((dow - (isodow({TODAY}) - 1) + 7) % 7 AS INTEGER) AS TIMESTAMP)
            + hour * INTERVAL 1 HOUR AS t0
  FROM common),
cand AS (SELECT *, CASE WHEN t0 <= {NOW_TS} THEN t0 + INTERVAL 7 DAY ELSE t0 END AS st FROM c0),
busy AS (
  SELECT coach_id, member_id, {_SESSION_START} AS s_start,
         {_SESSION_START} + duration * INTERVAL 1 MINUTE AS s_end
  FROM sessions WHERE lower(status) <> 'cancelled' AND session_date >= {TODAY}),
free AS (
  SELECT * FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.coach_id = c.coach_id
                      AND c.st < b.s_end AND c.st + INTERVAL 60 MINUTE > b.s_start)
    AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.member_id = c.member_id
                      AND c.st < b.s_end AND c.st + INTERVAL 60 MINUTE > b.s_start)),
scored AS (
  SELECT f.*, CASE WHEN COALESCE(list_contains(cp.pref_hours, f.hour), false)
                        AND COALESCE(list_contains(mp.pref_hours, f.hour), false) THEN 4
                   WHEN COALESCE(list_contains(cp.pref_hours, f.hour), false) THEN 3
                   WHEN COALESCE(list_contains(mp.pref_hours, f.hour), false) THEN 2
                   ELSE 1 END AS preference_score
  FROM free f
  LEFT JOIN prefs cp ON cp.user_id = f.coach_id AND cp.user_type = 'coach'
  LEFT JOIN prefs mp ON mp.user_id = f.member_id AND mp.user_type = 'member'
  WHERE f.st > {NOW_TS}),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY coach_id, member_id
                               ORDER BY preference_score DESC, st) AS INTEGER) AS rank
  FROM scored)
SELECT coach_id, member_id, strftime(st, '%Y-%m-%d') AS date, day_of_week AS day, hour,
       preference_score, rank
FROM ranked WHERE rank <= 10
""", ["free_days", "user_preferences", "member_coach", "sessions"], "X2 X1 F13 J10 U2 U3 U4 W4 S4")
def _match_slots(t):
    return sc.match_slots(t.member_coach, t.free_days, t.user_preferences, t.sessions, NOW, 60, 10)


@register("schedule_grid", f"""
WITH {_WEEKLY}, {_PREFS},
pairs AS (SELECT DISTINCT coach_id, member_id FROM member_coach),
grid AS (SELECT p.coach_id, p.member_id, CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour
         FROM pairs p, (SELECT unnest(range(7)) AS d) dd, (SELECT unnest(range(24)) AS h) hh),
wk AS (SELECT *, isodow(session_date) - 1 AS dow, {HOUR.format('session_time')} AS hour
       FROM sessions WHERE session_date BETWEEN DATE '{WEEK_START}' AND DATE '{WEEK_START}' + 6),
cs AS (SELECT coach_id, dow, hour, COUNT(*) AS n FROM wk GROUP BY 1, 2, 3),
ms AS (SELECT member_id, dow, hour, COUNT(*) AS n FROM wk GROUP BY 1, 2, 3),
g AS (
  SELECT g.coach_id, g.member_id, g.dow, g.hour,
         ca.user_id IS NOT NULL AND COALESCE(cs.n, 0) = 0 AS coach_available,
         ma.user_id IS NOT NULL AND COALESCE(ms.n, 0) = 0 AS member_available,
         COALESCE(list_contains(cp.pref_hours, g.hour), false) AS coach_preferred,
         COALESCE(list_contains(mp.pref_hours, g.hour), false) AS member_preferred,
         COALESCE(cs.n, 0) AS coach_sessions, COALESCE(ms.n, 0) AS member_sessions
  FROM grid g
  LEFT JOIN slots ca ON ca.user_id = g.coach_id AND ca.user_type = 'coach'
                    AND ca.dow = g.dow AND ca.hour = g.hour
  LEFT JOIN slots ma ON ma.user_id = g.member_id AND ma.user_type = 'member'
                    AND ma.dow = g.dow AND ma.hour = g.hour
  LEFT JOIN cs ON cs.coach_id = g.coach_id AND cs.dow = g.dow AND cs.hour = g.hour
  LEFT JOIN ms ON ms.member_id = g.member_id AND ms.dow = g.dow AND ms.hour = g.hour
  LEFT JOIN prefs cp ON cp.user_id = g.coach_id AND cp.user_type = 'coach'
  LEFT JOIN prefs mp ON mp.user_id = g.member_id AND mp.user_type = 'member')
SELECT coach_id, member_id,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][dow + 1] AS day_of_week,
       hour, coach_available, member_available, coach_preferred, member_preferred,
       coach_sessions, member_sessions, coach_available AND member_available AS available_for_both,
       CASE WHEN coach_available AND member_available THEN
         CASE WHEN coach_preferred AND member_preferred THEN 4 WHEN coach_preferred THEN 3
              WHEN member_preferred THEN 2 ELSE 1 END ELSE 0 END AS preference_score
FROM g
""", ["free_days", "user_preferences", "member_coach", "sessions"], "X3 J18 F10 F15")
def _schedule_grid(t):
    return sc.schedule_grid(t.member_coach, t.free_days, t.user_preferences, t.sessions, WEEK_START)


_EFFECTIVE = f"""
mem AS (SELECT DISTINCT member_id AS user_id FROM member_coach),
spine AS (
  SELECT m.user_id, CAST(DATE '{WEEK_START}' + CAST(d AS INTEGER) AS DATE) AS date,
         CAST(h AS INTEGER) AS hour
  FROM mem m, (SELECT unnest(range(7)) AS d) dd, (SELECT unnest(range(8, 22)) AS h) hh),
fd AS (SELECT user_id, {DOW.format('day_of_week')} AS dow, is_available AS w_av,
              COALESCE({HOUR.format('start_time')}, 8) AS w_start,
              COALESCE({HOUR.format('end_time')}, 20) AS w_end
       FROM free_days WHERE user_type = 'member'),
av AS (
  SELECT s.user_id, s.date, s.hour,
         COALESCE(o.is_available,
                  COALESCE(fd.w_av AND s.hour >= fd.w_start AND s.hour < fd.w_end, false)) AS available
  FROM spine s
  LEFT JOIN availability_slots o ON o.user_id = s.user_id AND o.user_type = 'member'
                                AND o.slot_date = s.date AND o.hour = s.hour
  LEFT JOIN fd ON fd.user_id = s.user_id AND fd.dow = isodow(s.date) - 1)"""


@register("group_availability", f"""
WITH {_EFFECTIVE}
SELECT mc.coach_id, av.date, av.hour,
       COUNT(CASE WHEN av.available THEN 1 END) AS available_count,
       COUNT(*) AS members_considered
FROM member_coach mc JOIN av ON av.user_id = mc.member_id
GROUP BY mc.coach_id, av.date, av.hour
""", ["member_coach", "availability_slots", "free_days"], "X4 A28 J17 F12")
def _group_availability(t):
    return sc.group_availability(t.member_coach, t.availability_slots, t.free_days,
                                 WEEK_START, "2024-01-28")


@register("available_members", f"""
WITH {_EFFECTIVE}
SELECT mc.coach_id, av.date, av.hour, mc.member_id, m.name
FROM member_coach mc JOIN av ON av.user_id = mc.member_id JOIN members m ON m.id = mc.member_id
WHERE av.available
""", ["member_coach", "availability_slots", "free_days", "members"], "X4 J17 A24")
def _available_members(t):
    return sc.available_members(t.member_coach, t.members, t.availability_slots, t.free_days,
                                WEEK_START, "2024-01-28")


@register("common_free_hours", f"""
WITH people AS (SELECT DISTINCT coach_id AS user_id, 'coach' AS user_type FROM member_coach
                UNION SELECT DISTINCT member_id, 'member' FROM member_coach),
spine AS (
  SELECT p.user_id, p.user_type, CAST(DATE '{WEEK_START}' + CAST(d AS INTEGER) AS DATE) AS date, CAST(h AS INTEGER) AS hour
  FROM people p, (SELECT unnest(range(7)) AS d) dd, (SELECT unnest(range(8, 22)) AS h) hh),
fd AS (SELECT user_id, user_type, {DOW.format('day_of_week')} AS dow, is_available AS w_av,
              COALESCE({HOUR.format('start_time')}, 8) AS w_start, COALESCE({HOUR.format('end_time')}, 20) AS w_end
       FROM free_days),
busy AS (
  SELECT coach_id, member_id, session_date, {HOUR.format('session_time')} * 60
         + CAST(split_part(session_time, ':', 2) AS INTEGER) AS st, greatest(duration, 1) AS d
  FROM sessions WHERE lower(status) <> 'cancelled'),
hours AS (
  SELECT s.* FROM spine s
  LEFT JOIN availability_slots o ON o.user_id = s.user_id AND o.user_type = s.user_type
                                AND o.slot_date = s.date AND o.hour = s.hour
  LEFT JOIN fd ON fd.user_id = s.user_id AND fd.user_type = s.user_type AND fd.dow = isodow(s.date) - 1
  WHERE COALESCE(o.is_available, COALESCE(fd.w_av AND s.hour >= fd.w_start AND s.hour < fd.w_end, false))
    AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.session_date = s.date
                      AND s.user_id = CASE s.user_type WHEN 'coach' THEN b.coach_id ELSE b.member_id END
                      AND b.st < (s.hour + 1) * 60 AND b.st + b.d > s.hour * 60))
SELECT p.coach_id, p.member_id, c.date, CAST(COUNT(*) AS INTEGER) AS free_hours,
       string_agg(CAST(c.hour AS VARCHAR), ',' ORDER BY c.hour) AS hours
FROM (SELECT DISTINCT coach_id, member_id FROM member_coach) p
JOIN hours c ON c.user_id = p.coach_id AND c.user_type = 'coach'
JOIN hours m ON m.user_id = p.member_id AND m.user_type = 'member' AND m.date = c.date AND m.hour = c.hour
GROUP BY 1, 2, 3
""", ["member_coach", "availability_slots", "free_days", "sessions"], "U2 U3 J17")
def _common_free_hours(t):
    free = hm.common_free_hours(t.member_coach, t.availability_slots, t.free_days, t.sessions,
                                WEEK_START, "2024-01-28", sc.GROUP_HOURS)
    return free.select("coach_id", "member_id", "date", "free_hours",
                       F.array_join(hm.hours_of(F.col("free")).cast("array<string>"), ",").alias("hours"))


@register("month_calendar", """
WITH days AS (
  SELECT u.id AS user_id, u.user_type, CAST(d AS DATE) AS date
  FROM all_users u, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31',
                                                   INTERVAL 1 DAY)) AS d) dd),
per AS (
  SELECT user_id, user_type, slot_date AS date,
         array_to_string(list_sort(list(hour) FILTER (WHERE is_available)), ',') AS available_hours,
         array_to_string(list_sort(list(hour) FILTER (WHERE NOT is_available)), ',') AS blocked_hours
  FROM availability_slots
  WHERE slot_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
  GROUP BY 1, 2, 3)
SELECT d.user_id, d.user_type, strftime(d.date, '%Y-%m-%d') AS date, dayname(d.date) AS day_of_week,
       CAST(dayofmonth(d.date) AS INTEGER) AS day_number,
       COALESCE(p.available_hours, '') AS available_hours, COALESCE(p.blocked_hours, '') AS blocked_hours
FROM days d LEFT JOIN per p ON p.user_id = d.user_id AND p.user_type = d.user_type AND p.date = d.date
""", ["all_users", "availability_slots"], "X5 J18 A24 F11")
def _month_calendar(t):
    m = sc.month_calendar(t.all_users.select(F.col("id").alias("user_id"), "user_type"),
                          t.availability_slots, 2024, 1)
    ent = F.array_sort(F.map_entries("slots"))
    hours = lambda flag: F.array_join(F.transform(
        F.filter(ent, lambda e: e["value"] == flag), lambda e: e["key"].cast("string")), ",")
    return m.select("user_id", "user_type", "date", "day_of_week", "day_number",
                    hours(True).alias("available_hours"), hours(False).alias("blocked_hours"))


@register("availability_map", """
SELECT user_id, user_type, slot_date,
       COALESCE(array_to_string(list_sort(list(hour) FILTER (WHERE is_available)), ','), '')
         AS available_hours,
       COALESCE(array_to_string(list_sort(list(hour) FILTER (WHERE NOT is_available)), ','), '')
         AS blocked_hours
FROM availability_slots
WHERE slot_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
GROUP BY user_id, user_type, slot_date
""", ["availability_slots"], "X40 A24 P5")
def _availability_map(t):
    m = sc.availability_map(t.availability_slots, "2024-01-10", "2024-01-20")
    return m.select("user_id", "user_type", "slot_date",
                    F.array_join(F.col("available_hours").cast("array<string>"), ",").alias("available_hours"),
                    F.array_join(F.col("blocked_hours").cast("array<string>"), ",").alias("blocked_hours"))


@register("bulk_availability", """
WITH req AS (
  SELECT user_id, user_type, CAST(d AS DATE) AS slot_date, CAST(h AS INTEGER) AS hour, is_available,
         seq, 1 AS prio
  FROM bulk_requests,
       LATERAL (SELECT unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d) dd,
       LATERAL (SELECT unnest(range(start_hour, end_hour + 1)) AS h) hh
  WHERE h BETWEEN 0 AND 23),
allw AS (
  SELECT user_id, user_type, slot_date, hour, is_available, seq, 0 AS prio FROM availability_slots
  UNION ALL SELECT * FROM req)
SELECT user_id, user_type, slot_date, hour, is_available FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, user_type, slot_date, hour
                               ORDER BY prio DESC, seq DESC) AS rn FROM allw) t
WHERE rn = 1
""", ["bulk_requests", "availability_slots"], "X11 X10 W5 F12")
def _bulk_availability(t):
    new = sc.bulk_requests_to_slots(t.bulk_requests)
    base = t.availability_slots.select("user_id", "user_type", "slot_date", "hour", "is_available", "seq")
    return up.upsert(base, new, ["user_id", "user_type", "slot_date", "hour"], ["seq"],
                     keep_first=()).drop("seq")


@register("slot_conflicts", """
SELECT coach_id, session_date, session_time, COUNT(*) AS sessions
FROM sessions WHERE lower(status) <> 'cancelled'
GROUP BY coach_id, session_date, session_time HAVING COUNT(*) > 1
""", ["sessions"], "J11 P10")
def _slot_conflicts(t):
    return bk.slot_conflicts(t.sessions, "coach_id")


_VALIDATE = f"""
req AS (
  -- sent twice as it was: one request; of different ones under one id the first has it
  SELECT DISTINCT request_id, coach_id, member_id, session_date, session_time, duration,
         dense_rank() OVER (PARTITION BY request_id ORDER BY coach_id, member_id, session_date, session_time, duration) > 1 AS repeated
  FROM booking_requests),
asg AS (SELECT DISTINCT member_id, coach_id FROM member_coach),
act AS (SELECT * FROM sessions WHERE lower(status) <> 'cancelled'),
pre AS (
  SELECT r.*,
    CASE WHEN r.repeated THEN {q(bk.REASONS['repeated'])}
         WHEN r.member_id IS NULL OR r.coach_id IS NULL OR r.session_date IS NULL
              OR r.session_time IS NULL OR r.duration IS NULL THEN {q(bk.REASONS['missing'])}
         WHEN NOT EXISTS (SELECT 1 FROM members m JOIN coaches c ON m.gym_id = c.gym_id WHERE m.id = r.member_id AND c.id = r.coach_id) THEN {q(bk.REASONS['tenancy'])}
         WHEN NOT EXISTS (SELECT 1 FROM asg a WHERE a.member_id = r.member_id
                          AND a.coach_id = r.coach_id) THEN {q(bk.REASONS['assignment'])}
         WHEN EXISTS (SELECT 1 FROM act s WHERE s.coach_id = r.coach_id
                      AND s.session_date = r.session_date AND s.session_time = r.session_time)
              THEN {q(bk.REASONS['coach_conflict'])}
         WHEN EXISTS (SELECT 1 FROM act s WHERE s.member_id = r.member_id
                      AND s.session_date = r.session_date AND s.session_time = r.session_time)
              THEN {q(bk.REASONS['member_conflict'])}
    END AS pre_reason
  FROM req r),
steps AS (
  -- booking one after the other: an open request (0) is taken (1) when it is first in both of
  -- its cells, and refused (2) once a taken one shares a cell with it
  SELECT 0 AS k, request_id, coach_id, member_id, session_date, session_time, 0 AS st
  FROM pre WHERE pre_reason IS NULL
  UNION ALL
  SELECT k + 1, request_id, coach_id, member_id, session_date, session_time,
         CASE WHEN st <> 0 THEN st WHEN c_taken OR m_taken THEN 2
              WHEN request_id = c_first AND request_id = m_first THEN 1 ELSE 0 END
  FROM (SELECT *, bool_or(st = 1) OVER cw AS c_taken, bool_or(st = 1) OVER mw AS m_taken,
               min(CASE WHEN st = 0 THEN request_id END) OVER cw AS c_first,
               min(CASE WHEN st = 0 THEN request_id END) OVER mw AS m_first,
               count(CASE WHEN st = 0 THEN 1 END) OVER () AS n_open
        FROM steps
        WINDOW cw AS (PARTITION BY coach_id, session_date, session_time),
               mw AS (PARTITION BY member_id, session_date, session_time)) w
  WHERE n_open > 0),
taken AS (SELECT DISTINCT request_id FROM steps WHERE st = 1),
v AS (
  SELECT p.request_id, p.coach_id, p.member_id, p.session_date, p.session_time, p.duration,
    CASE WHEN p.pre_reason IS NOT NULL THEN p.pre_reason
         WHEN p.request_id NOT IN (SELECT request_id FROM taken)
              THEN {q(bk.REASONS['batch_conflict'])} END AS reason
  FROM pre p)"""


@register("validate_bookings", f"""
WITH RECURSIVE {_VALIDATE}
SELECT *, reason IS NULL AS accepted FROM v
""", ["booking_requests", "members", "coaches", "member_coach", "sessions"], "X7 J9 J11 J13 X41")
def _validate_bookings(t):
    return bk.validate_bookings(t.booking_requests, t.members, t.coaches, t.member_coach, t.sessions)


@register("session_payments", f"""
WITH RECURSIVE {_VALIDATE}
SELECT v.request_id, v.member_id, m.gym_id,
       CAST(CASE m.membership_type WHEN 'Basic' THEN 25.0 WHEN 'Premium' THEN 20.0 WHEN 'VIP' THEN 15.0
            ELSE 25.0 END AS DOUBLE) AS amount,
       'Session' AS payment_type, 'Pending' AS status,
       'Payment for session on ' || strftime(v.session_date, '%Y-%m-%d') || ' at ' || v.session_time AS notes
FROM v JOIN members m ON m.id = v.member_id
WHERE v.reason IS NULL
""", ["booking_requests", "members", "coaches", "member_coach", "sessions"], "X8")
def _session_payments(t):
    v = bk.validate_bookings(t.booking_requests, t.members, t.coaches, t.member_coach, t.sessions)
    return bl.session_payments(v.filter("accepted"), t.members)


@register("renewal_payments", """
SELECT id AS member_id, gym_id, membership_type,
       CAST(CASE membership_type WHEN 'Basic' THEN 50.0 WHEN 'Premium' THEN 100.0 WHEN 'VIP' THEN 200.0 END
            AS DOUBLE) AS amount,
       'Membership' AS payment_type,
       CASE WHEN membership_type IN ('Basic', 'Premium', 'VIP') THEN 'Pending' ELSE 'Rejected' END AS status,
       'Monthly membership renewal - ' || membership_type AS notes
FROM members
""", ["members"], "X9 D3")
def _renewal_payments(t):
    return bl.renewal_payments(t.members)


@register("gym_capacity", """
SELECT gym_id, COUNT(*) AS members, ROUND(least(100.0, CAST(COUNT(*) AS DOUBLE) / 100.0 * 100.0), 2)
         AS capacity_pct
FROM members GROUP BY gym_id
""", ["members"], "A27")
def _gym_capacity(t):
    return bl.gym_capacity(t.members)


@register("blocked_hours", f"""
WITH b AS (
  SELECT id, coach_id, member_id, {_SESSION_START} AS st,
         unnest(range(0, greatest(1, CAST(ceil(duration / 60.0) AS INTEGER)))) AS i
  FROM sessions)
SELECT id, coach_id, member_id, dayname(st + i * INTERVAL 1 HOUR) AS day_of_week,
       CAST(hour(st + i * INTERVAL 1 HOUR) AS INTEGER) AS hour
FROM b
""", ["sessions"], "F14 F10")
def _blocked_hours(t):
    return sc.blocked_hours(t.sessions)
