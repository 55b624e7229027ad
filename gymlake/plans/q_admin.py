"""Registered queries: plans, upserts, deletes, imports and feedback (J19, J22, X12, X13,
X19, X20, X23, X24, X30, X31, A22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.operators import meal_plans as mp
from gymlake.operators import upserts as up
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import q
from gymlake.sources.fixtures import NUTRITION_AS_OF, SESSION_AS_OF

_EFFECTIVE_PLAN = """
p AS (SELECT id AS plan_id, member_id, created_at, plan_name, daily_calories, daily_protein,
             daily_carbs, daily_fat FROM nutrition_plans),
sel AS (SELECT s.member_id, p.plan_id, p.plan_name, p.daily_calories, p.daily_protein, p.daily_carbs,
               p.daily_fat
        FROM member_plan_selections s JOIN p ON p.plan_id = s.selected_plan_id),
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_id
                                                   ORDER BY created_at DESC, plan_id DESC) AS rn FROM p) x
        WHERE rn = 1),
ep AS (
  SELECT m.id AS member_id, COALESCE(sel.plan_id, lat.plan_id) AS plan_id,
         COALESCE(p.plan_name, 'Default Plan') AS plan_name,
         COALESCE(p.daily_calories, 2000) AS daily_calories, COALESCE(p.daily_protein, 150) AS daily_protein,
         COALESCE(p.daily_carbs, 250) AS daily_carbs, COALESCE(p.daily_fat, 70) AS daily_fat,
         CASE WHEN sel.member_id IS NOT NULL THEN 'selected' WHEN lat.member_id IS NOT NULL THEN 'latest'
              ELSE 'default' END AS source,
         sel.member_id IS NULL AS is_default
  FROM members m LEFT JOIN sel ON sel.member_id = m.id LEFT JOIN lat ON lat.member_id = m.id
  LEFT JOIN p ON p.plan_id = COALESCE(sel.plan_id, lat.plan_id))"""


@register("effective_plan", f"""
WITH {_EFFECTIVE_PLAN}
SELECT * FROM ep
""", ["nutrition_plans", "member_plan_selections", "members"], "J19 W3")
def _effective_plan(t):
    return mp.effective_plan(t.members, t.nutrition_plans, t.member_plan_selections)


@register("plan_progress", f"""
WITH {_EFFECTIVE_PLAN},
day AS (SELECT member_id, SUM(CAST(total_calories AS DOUBLE)) AS calories,
               SUM(CAST(total_protein AS DOUBLE)) AS protein, SUM(CAST(total_carbs AS DOUBLE)) AS carbs,
               SUM(CAST(total_fat AS DOUBLE)) AS fat
        FROM nutrition_logs WHERE log_date = DATE '{NUTRITION_AS_OF}' GROUP BY member_id)
SELECT ep.member_id, ep.plan_id, ep.source,
       round(day.calories, 2) AS calories, round(day.protein, 2) AS protein,
       round(day.carbs, 2) AS carbs, round(day.fat, 2) AS fat,
       round(CASE WHEN ep.daily_calories > 0 THEN day.calories / ep.daily_calories * 100.0 ELSE 0.0 END, 2)
         AS calories_progress,
       round(CASE WHEN ep.daily_protein > 0 THEN day.protein / ep.daily_protein * 100.0 ELSE 0.0 END, 2)
         AS protein_progress,
       round(CASE WHEN ep.daily_carbs > 0 THEN day.carbs / ep.daily_carbs * 100.0 ELSE 0.0 END, 2)
         AS carbs_progress,
       round(CASE WHEN ep.daily_fat > 0 THEN day.fat / ep.daily_fat * 100.0 ELSE 0.0 END, 2) AS fat_progress
FROM ep JOIN day ON day.member_id = ep.member_id
""", ["nutrition_plans", "member_plan_selections", "members", "nutrition_logs"], "A22 J19 X38")
def _plan_progress(t):
    return mp.plan_progress(t.members, t.nutrition_plans, t.member_plan_selections, t.nutrition_logs,
                            NUTRITION_AS_OF)


_PLAN_JSON = ('{"meal_plan": "MAP(VARCHAR, MAP(VARCHAR, STRUCT(name VARCHAR, ingredients VARCHAR[], '
              'nutrition STRUCT(calories DOUBLE, protein DOUBLE, carbs DOUBLE, fat DOUBLE))))", '
              '"shopping_list": ["VARCHAR"]}')


@register("explode_plan", f"""
WITH d AS (SELECT id AS plan_id, member_id,
                  CASE WHEN json_valid(plan_data) THEN from_json(plan_data, '{_PLAN_JSON}') END AS doc
           FROM nutrition_plans),
days AS (SELECT plan_id, member_id, unnest(map_entries(doc.meal_plan)) AS dm FROM d),
meals AS (SELECT plan_id, member_id, dm.key AS day, unnest(map_entries(dm.value)) AS mm FROM days)
SELECT plan_id, member_id, day, mm.key AS meal, mm.value.name AS meal_name,
       mm.value.nutrition.calories AS calories, mm.value.nutrition.protein AS protein,
       unnest(mm.value.ingredients) AS ingredient
FROM meals
""", ["nutrition_plans"], "X20 F24")
def _explode_plan(t):
    return mp.explode_plan(t.nutrition_plans)


@register("shopping_list", f"""
SELECT DISTINCT plan_id, item FROM (
  SELECT id AS plan_id,
         unnest((CASE WHEN json_valid(plan_data) THEN from_json(plan_data, '{_PLAN_JSON}') END)
                .shopping_list) AS item
  FROM nutrition_plans) x
""", ["nutrition_plans"], "X20 F24 A25")
def _shopping_list(t):
    return mp.shopping_list(t.nutrition_plans)


@register("plan_list", """
SELECT member_id, id AS plan_id, plan_name, coach_id,
       CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS status,
       strftime(created_at, '%Y-%m-%d') AS created, created_at
FROM nutrition_plans
""", ["nutrition_plans"], "X31 P15")
def _plan_list(t):
    return mp.plan_list(t.nutrition_plans)


@register("coach_plans", """
SELECT np.coach_id, np.member_id, m.name AS member_name, np.id AS plan_id, np.plan_name,
       CASE WHEN np.is_active THEN 'active' ELSE 'inactive' END AS status
FROM nutrition_plans np
JOIN member_coach mc ON mc.coach_id = np.coach_id AND mc.member_id = np.member_id
JOIN members m ON m.id = np.member_id
""", ["nutrition_plans", "member_coach", "members"], "J22 J9")
def _coach_plans(t):
    return mp.coach_plans(t.nutrition_plans, t.members, t.member_coach)


@register("validate_feedback", f"""
SELECT f.feedback_id, f.coach_id, f.member_id, f.feedback_type, COALESCE(f.rating, 5) AS rating,
       CASE WHEN COALESCE(length(trim(f.message)), 0) = 0 THEN {q(mp.FEEDBACK_REASONS['empty'])}
            WHEN a.member_id IS NULL THEN {q(mp.FEEDBACK_REASONS['not_assigned'])} END AS reason,
       COALESCE(length(trim(f.message)), 0) > 0 AND a.member_id IS NOT NULL AS accepted
FROM feedback_requests f
LEFT JOIN (SELECT DISTINCT coach_id, member_id FROM member_coach) a
  ON a.coach_id = f.coach_id AND a.member_id = f.member_id
""", ["feedback_requests", "member_coach"], "X30 J9")
def _validate_feedback(t):
    return mp.validate_feedback(t.feedback_requests, t.member_coach)


@register("select_plans", """
WITH valid AS (
  SELECT u.member_id, u.selected_plan_id, u.selected_plan_id IS NULL AS is_default, u.seq, 1 AS prio
  FROM plan_selection_updates u
  WHERE u.selected_plan_id IS NULL
     OR EXISTS (SELECT 1 FROM nutrition_plans p WHERE p.id = u.selected_plan_id
                AND p.member_id = u.member_id)),
allw AS (
  SELECT member_id, selected_plan_id, is_default, CAST(0 AS BIGINT) AS seq, 0 AS prio
  FROM member_plan_selections
  UNION ALL SELECT * FROM valid)
SELECT member_id, selected_plan_id, is_default FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY prio DESC, seq DESC) AS rn FROM allw) x
WHERE rn = 1
""", ["plan_selection_updates", "nutrition_plans", "member_plan_selections"], "X12 X10 J9")
def _select_plans(t):
    return up.select_plans(t.member_plan_selections, t.nutrition_plans, t.plan_selection_updates)


_DELETED = "SELECT m.id FROM members m JOIN gyms g ON g.id = m.gym_id WHERE g.address = 'ASIA'"


@register("cascade_delete", f"""
WITH gone AS ({_DELETED})
SELECT 'members' AS table_name, COUNT(*) AS remaining_rows FROM members WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'member_coach', COUNT(*) FROM member_coach WHERE member_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sessions', COUNT(*) FROM sessions WHERE member_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'nutrition_logs', COUNT(*) FROM nutrition_logs WHERE member_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'payments', COUNT(*) FROM payments WHERE member_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'nutrition_goals', COUNT(*) FROM nutrition_goals WHERE member_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'nutrition_plans', COUNT(*) FROM nutrition_plans WHERE member_id NOT IN (SELECT id FROM gone)
""", ["members", "gyms", "member_coach", "sessions", "nutrition_logs", "payments", "nutrition_goals",
      "nutrition_plans"], "X13")
def _cascade_delete(t):
    gone = (t.members.join(t.gyms.filter(F.col("address") == "ASIA")
                           .select(F.col("id").alias("gym_id")), "gym_id")
            .select(F.col("id").alias("member_id")))
    kept = up.cascade_delete(gone, {
        "members": (t.members.withColumnRenamed("id", "member_id"), "member_id"),
        "member_coach": (t.member_coach, "member_id"), "sessions": (t.sessions, "member_id"),
        "nutrition_logs": (t.nutrition_logs, "member_id"), "payments": (t.payments, "member_id"),
        "nutrition_goals": (t.nutrition_goals, "member_id"),
        "nutrition_plans": (t.nutrition_plans, "member_id")})
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("remaining_rows")).select(
            F.lit(name).alias("table_name"), "remaining_rows")
        out = part if out is None else out.unionByName(part)
    return out


@register("session_status_update", f"""
WITH patch AS (
  SELECT id, CASE WHEN duration = 0 THEN 'done'
                  WHEN lower(status) = 'scheduled' AND session_date < DATE '{SESSION_AS_OF}' THEN 'Completed'
             END AS new_status
  FROM sessions),
upd AS (
  SELECT s.id, CASE WHEN p.new_status IN ('Scheduled', 'Completed', 'Cancelled') THEN p.new_status
                    ELSE s.status END AS status
  FROM sessions s LEFT JOIN patch p ON p.id = s.id)
SELECT status, COUNT(*) AS sessions FROM upd GROUP BY status
""", ["sessions"], "X19")
def _session_status_update(t):
    s = t.sessions
    patch = s.select("id", F.when(F.col("duration") == 0, F.lit("done"))
                     .when((F.lower("status") == "scheduled") & (F.col("session_date") < F.lit(SESSION_AS_OF)
                                                                  .cast("date")), F.lit("Completed"))
                     .alias("status")).filter(F.col("status").isNotNull())
    upd = up.update_rows(s.select("id", "status"), patch, "id",
                         allowed={"status": ("Scheduled", "Completed", "Cancelled")})
    return upd.groupBy("status").agg(F.count(F.lit(1)).alias("sessions"))


@register("validate_members", f"""
WITH r AS (
  SELECT i.*, lower(i.email) AS le,
         CASE WHEN lower(i.membership_type) = 'basic' THEN 'Basic'
              WHEN lower(i.membership_type) = 'premium' THEN 'Premium'
              WHEN lower(i.membership_type) = 'vip' THEN 'VIP' END AS tier,
         EXISTS (SELECT 1 FROM members m WHERE lower(m.email) = lower(i.email)) AS taken,
         EXISTS (SELECT 1 FROM coaches c WHERE c.id = i.coach_id AND c.gym_id = i.gym_id
                 AND c.status = 'Active') AS coach_ok
  FROM member_imports i),
pre AS (
  SELECT *, CASE WHEN name IS NULL OR email IS NULL OR membership_type IS NULL
                   THEN {q(up.IMPORT_REASONS['missing'])}
                 WHEN NOT (contains(email, '@') AND contains(email, '.')) THEN {q(up.IMPORT_REASONS['email'])}
                 WHEN tier IS NULL THEN {q(up.IMPORT_REASONS['tier'])}
                 WHEN taken THEN {q(up.IMPORT_REASONS['duplicate'])}
                 WHEN coach_id IS NOT NULL AND NOT coach_ok THEN {q(up.IMPORT_REASONS['coach'])} END AS pre_reason
  FROM r),
firsts AS (SELECT le, min(import_id) AS first_id FROM pre WHERE pre_reason IS NULL GROUP BY le)
SELECT p.import_id, p.gym_id, p.name, p.email, p.tier AS membership_type, p.coach_id,
       COALESCE(p.pre_reason, CASE WHEN f.first_id < p.import_id THEN {q(up.IMPORT_REASONS['batch'])} END)
         AS reason,
       COALESCE(p.pre_reason, CASE WHEN f.first_id < p.import_id THEN 'x' END) IS NULL AS accepted
FROM pre p LEFT JOIN firsts f ON f.le = p.le
""", ["member_imports", "members", "coaches"], "X23 F5 J12 J13")
def _validate_members(t):
    return up.validate_members(t.member_imports, t.members, t.coaches)


@register("reassign_coach", f"""
WITH changes AS (
  SELECT DISTINCT mc.member_id, mc.coach_id + 1 AS coach_id, DATE '{SESSION_AS_OF}' AS assigned_date
  FROM member_coach mc JOIN coaches c ON c.id = mc.coach_id WHERE c.status = 'Inactive')
SELECT member_id, coach_id, assigned_date FROM member_coach
WHERE member_id NOT IN (SELECT member_id FROM changes)
UNION ALL SELECT member_id, coach_id, assigned_date FROM changes
""", ["member_coach", "coaches"], "X24")
def _reassign_coach(t):
    inactive = t.coaches.filter(F.col("status") == "Inactive").select(F.col("id").alias("coach_id"))
    changes = (t.member_coach.join(inactive, "coach_id")
               .select("member_id", (F.col("coach_id") + 1).alias("coach_id"),
                       F.lit(SESSION_AS_OF).cast("date").alias("assigned_date")).distinct())
    return up.reassign_coach(t.member_coach, changes)
