"""Registered queries: nutrition analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.functions import nutrition_fx as nfx
from gymlake.operators import nutrition as nu
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import feedback_sql, health_score_sql, q, recommendations_sql
from gymlake.sources.fixtures import NUTRITION_AS_OF

AS_OF = NUTRITION_AS_OF
D = f"DATE '{AS_OF}'"


def _avg(c, alias=None):
    return f"ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS {alias or 'avg_' + c.split('_')[-1]}"


def _dsum(c, alias):
    return f"CAST(SUM({c}) AS DECIMAL(18,2)) AS {alias}"


@register("member_nutrition_summary", f"""
SELECT mc.coach_id, m.id AS member_id, m.name, m.email, m.membership_type,
       COUNT(n.member_id) AS nutrition_entries,
       {_avg('n.total_calories')}, {_avg('n.total_protein')},
       MAX(n.created_at) AS last_nutrition_entry
FROM member_coach mc JOIN members m ON m.id = mc.member_id
LEFT JOIN nutrition_logs n ON n.member_id = m.id
GROUP BY mc.coach_id, m.id, m.name, m.email, m.membership_type
""", ["member_coach", "members", "nutrition_logs"], "A15 J5 J7")
def _member_nutrition_summary(t):
    return nu.member_nutrition_summary(t.members, t.member_coach, t.nutrition_logs)


@register("coach_nutrition_stats", f"""
SELECT mc.coach_id, COUNT(DISTINCT mc.member_id) AS total_members,
       COUNT(DISTINCT n.member_id) AS members_with_nutrition,
       COUNT(n.member_id) AS total_nutrition_entries,
       {_avg('n.total_calories')}, {_avg('n.total_protein')}, {_avg('n.total_carbs')},
       {_avg('n.total_fat')},
       COUNT(CASE WHEN n.total_calories > 0 THEN 1 END) AS entries_with_calories
FROM member_coach mc LEFT JOIN nutrition_logs n ON n.member_id = mc.member_id
GROUP BY mc.coach_id
""", ["member_coach", "nutrition_logs"], "A16")
def _coach_nutrition_stats(t):
    return nu.coach_nutrition_stats(t.member_coach, t.nutrition_logs)


@register("daily_nutrition", f"""
SELECT member_id, log_date, {_dsum('total_calories', 'calories')}, {_dsum('total_protein', 'protein')},
       {_dsum('total_carbs', 'carbs')}, {_dsum('total_fat', 'fat')}, COUNT(*) AS entries_count
FROM nutrition_logs GROUP BY member_id, log_date
""", ["nutrition_logs"], "A20")
def _daily_nutrition(t):
    return nu.daily_nutrition(t.nutrition_logs)


@register("nutrition_trends", f"""
SELECT mc.coach_id, m.id AS member_id, m.name, n.log_date AS date,
       {_avg('n.total_calories')}, {_avg('n.total_protein')}, {_avg('n.total_carbs')},
       {_avg('n.total_fat')}, COUNT(*) AS entries_count
FROM member_coach mc JOIN members m ON m.id = mc.member_id
JOIN nutrition_logs n ON n.member_id = m.id
WHERE n.log_date >= {D} - 7
GROUP BY mc.coach_id, m.id, m.name, n.log_date
""", ["member_coach", "members", "nutrition_logs"], "A17")
def _nutrition_trends(t):
    return nu.nutrition_trends(t.members, t.member_coach, t.nutrition_logs, AS_OF)


@register("nutrition_analytics", f"""
SELECT mc.coach_id, m.id AS member_id, split_part(m.name, ' ', 1) AS first_name,
       CASE WHEN position(' ' IN m.name) > 0 THEN substr(m.name, position(' ' IN m.name) + 1)
            ELSE '' END AS last_name,
       {_avg('n.total_calories')}, {_avg('n.total_protein')}, {_avg('n.total_carbs')},
       {_avg('n.total_fat')},
       COUNT(*) AS total_entries, COUNT(DISTINCT n.log_date) AS active_days,
       COUNT(CASE WHEN n.total_calories > 0 THEN 1 END) AS entries_with_calories
FROM member_coach mc JOIN members m ON m.id = mc.member_id
LEFT JOIN nutrition_logs n ON n.member_id = m.id
WHERE n.log_date >= {D} - 30
GROUP BY mc.coach_id, m.id, m.name
""", ["member_coach", "members", "nutrition_logs"], "A18 F7 P3 O6")
def _nutrition_analytics(t):
    return nu.nutrition_analytics(t.members, t.member_coach, t.nutrition_logs, "month", AS_OF)


@register("nutrition_analytics_all", f"""
SELECT mc.coach_id, m.id AS member_id, split_part(m.name, ' ', 1) AS first_name,
       CASE WHEN position(' ' IN m.name) > 0 THEN substr(m.name, position(' ' IN m.name) + 1)
            ELSE '' END AS last_name,
       {_avg('n.total_calories')}, {_avg('n.total_protein')}, {_avg('n.total_carbs')},
       {_avg('n.total_fat')},
       COUNT(n.member_id) AS total_entries, COUNT(DISTINCT n.log_date) AS active_days,
       COUNT(CASE WHEN n.total_calories > 0 THEN 1 END) AS entries_with_calories
FROM member_coach mc JOIN members m ON m.id = mc.member_id
LEFT JOIN nutrition_logs n ON n.member_id = m.id
GROUP BY mc.coach_id, m.id, m.name
""", ["member_coach", "members", "nutrition_logs"], "A18 D5")
def _nutrition_analytics_all(t):
    return nu.nutrition_analytics(t.members, t.member_coach, t.nutrition_logs, "all", AS_OF)


@register("meal_distribution", f"""
SELECT mc.coach_id, n.meal_type, COUNT(*) AS count, {_avg('n.total_calories')}
FROM nutrition_logs n JOIN members m ON n.member_id = m.id
JOIN member_coach mc ON m.id = mc.member_id
WHERE n.log_date >= {D} - 90
GROUP BY mc.coach_id, n.meal_type
""", ["nutrition_logs", "members", "member_coach"], "A19")
def _meal_distribution(t):
    return nu.meal_distribution(t.member_coach, t.nutrition_logs, "quarter", AS_OF)


@register("today_nutrition", f"""
SELECT member_id, meal_type, {_dsum('total_calories', 'calories')}, {_dsum('total_protein', 'protein')},
       {_dsum('total_carbs', 'carbs')}, {_dsum('total_fat', 'fat')}
FROM nutrition_logs WHERE log_date = {D}
GROUP BY ROLLUP (member_id, meal_type)
HAVING member_id IS NOT NULL
""", ["nutrition_logs"], "A21")
def _today_nutrition(t):
    return nu.today_nutrition(t.nutrition_logs, AS_OF)


_GOALS_CTE = """g AS (
  SELECT m.id AS member_id,
         COALESCE(ng.daily_calorie_goal, CAST(2000 AS DECIMAL(7,2))) AS daily_calorie_goal,
         COALESCE(ng.daily_protein_goal, CAST(150 AS DECIMAL(7,2))) AS daily_protein_goal,
         COALESCE(ng.daily_carbs_goal, CAST(250 AS DECIMAL(7,2))) AS daily_carbs_goal,
         COALESCE(ng.daily_fat_goal, CAST(70 AS DECIMAL(7,2))) AS daily_fat_goal,
         COALESCE(ng.goal_type, 'Maintenance') AS goal_type
  FROM members m LEFT JOIN nutrition_goals ng ON ng.member_id = m.id)"""


@register("goal_progress", f"""
WITH day AS (
  SELECT member_id, {_dsum('total_calories', 'calories')}, {_dsum('total_protein', 'protein')},
         {_dsum('total_carbs', 'carbs')}, {_dsum('total_fat', 'fat')}
  FROM nutrition_logs WHERE log_date = {D} GROUP BY member_id),
{_GOALS_CTE}
SELECT g.member_id, day.calories, day.protein, day.carbs, day.fat,
       ROUND(CAST(day.calories AS DOUBLE) * 100.0 / NULLIF(CAST(g.daily_calorie_goal AS DOUBLE), 0), 2)
         AS calories_progress,
       ROUND(CAST(day.protein AS DOUBLE) * 100.0 / NULLIF(CAST(g.daily_protein_goal AS DOUBLE), 0), 2)
         AS protein_progress,
       ROUND(CAST(day.carbs AS DOUBLE) * 100.0 / NULLIF(CAST(g.daily_carbs_goal AS DOUBLE), 0), 2)
         AS carbs_progress,
       ROUND(CAST(day.fat AS DOUBLE) * 100.0 / NULLIF(CAST(g.daily_fat_goal AS DOUBLE), 0), 2)
         AS fat_progress
FROM g JOIN day ON day.member_id = g.member_id
""", ["nutrition_logs", "members", "nutrition_goals"], "A22")
def _goal_progress(t):
    return nu.goal_progress(t.members, t.nutrition_goals, t.nutrition_logs, AS_OF)


_WS = f"({D} - CAST(isodow({D}) - 1 AS INTEGER))"


@register("weekly_nutrition", f"""
WITH sums AS (
  SELECT member_id, log_date, {_dsum('total_calories', 'calories')}, {_dsum('total_protein', 'protein')},
         {_dsum('total_carbs', 'carbs')}, {_dsum('total_fat', 'fat')}
  FROM nutrition_logs WHERE log_date BETWEEN {_WS} AND {_WS} + 6 GROUP BY member_id, log_date),
spine AS (SELECT m.id AS member_id, {_WS} + CAST(k AS INTEGER) AS log_date
          FROM members m, (SELECT unnest(range(7)) AS k) r)
SELECT sp.member_id, strftime(sp.log_date, '%Y-%m-%d') AS date, dayname(sp.log_date) AS day_name,
       COALESCE(s.calories, 0) AS calories, COALESCE(s.protein, 0) AS protein,
       COALESCE(s.carbs, 0) AS carbs, COALESCE(s.fat, 0) AS fat
FROM spine sp LEFT JOIN sums s ON s.member_id = sp.member_id AND s.log_date = sp.log_date
""", ["nutrition_logs", "members"], "X6 F11 F12 J18 D8")
def _weekly_nutrition(t):
    return nu.weekly_nutrition(t.members, t.nutrition_logs, AS_OF)


_DETECTED_TYPE = ('[{"name": "VARCHAR", "quantity": "DOUBLE", "calories": "DOUBLE", '
                  '"protein": "DOUBLE", "carbs": "DOUBLE", "fat": "DOUBLE", "confidence": "DOUBLE"}]')
_DEFAULT_FOOD = ("[{'name': 'Unknown Food Item', 'quantity': 100.0, 'calories': 200.0, 'protein': 8.0, "
                 "'carbs': 25.0, 'fat': 8.0, 'confidence': 0.3}]")
_FOOD_ROWS = f"""
parsed AS (
  SELECT id, member_id, meal_type, log_date,
         CASE WHEN json_valid(detected_foods) THEN from_json(detected_foods, '{_DETECTED_TYPE}') END
           AS foods
  FROM detected_meals),
rows AS (
  SELECT id, member_id, meal_type, log_date,
         unnest(CASE WHEN COALESCE(len(foods), 0) = 0 THEN {_DEFAULT_FOOD} ELSE foods END) AS food
  FROM parsed)"""


@register("detected_food_rows", f"""
WITH {_FOOD_ROWS}
SELECT id, member_id, meal_type, log_date, food.name AS custom_food_name, food.quantity AS quantity,
       food.calories AS total_calories, food.protein AS total_protein, food.carbs AS total_carbs,
       food.fat AS total_fat, food.confidence AS ai_confidence
FROM rows
""", ["detected_meals"], "X17 S4")
def _detected_food_rows(t):
    return nu.detected_food_rows(t.detected_meals).drop("pos")


@register("log_detected_foods", f"""
WITH {_FOOD_ROWS},
day AS (
  SELECT member_id, log_date AS analysis_date,
         ROUND(SUM(food.calories), 4) AS total_calories, ROUND(SUM(food.protein), 4) AS total_protein,
         ROUND(SUM(food.carbs), 4) AS total_carbs, ROUND(SUM(food.fat), 4) AS total_fat
  FROM rows GROUP BY member_id, log_date),
{_GOALS_CTE}
SELECT day.member_id, day.analysis_date, day.total_calories, day.total_protein, day.total_carbs,
       day.total_fat,
       {health_score_sql('day.total_calories', 'day.total_protein', 'day.total_carbs', 'day.total_fat')}
         AS health_score,
       {feedback_sql('day.total_calories', 'day.total_protein',
                     'COALESCE(g.daily_calorie_goal, 2000.0)', 'COALESCE(g.daily_protein_goal, 150.0)',
                     "COALESCE(g.goal_type, 'Maintenance')")} AS ai_feedback,
       {q(nu.ANALYSIS_SUGGESTION)} AS suggestions
FROM day LEFT JOIN g ON g.member_id = day.member_id
""", ["detected_meals", "members", "nutrition_goals"], "X17 F17 F18")
def _log_detected_foods(t):
    return nu.log_detected_foods(t.detected_meals, t.members, t.nutrition_goals)


@register("premium_detected_foods", f"""
WITH {_FOOD_ROWS},
day AS (
  SELECT member_id, log_date AS analysis_date,
         ROUND(SUM(food.calories), 4) AS total_calories, ROUND(SUM(food.protein), 4) AS total_protein,
         ROUND(SUM(food.carbs), 4) AS total_carbs, ROUND(SUM(food.fat), 4) AS total_fat
  FROM rows GROUP BY member_id, log_date),
{_GOALS_CTE}
SELECT day.member_id, day.analysis_date, day.total_calories, day.total_protein, day.total_carbs,
       day.total_fat,
       {health_score_sql('day.total_calories', 'day.total_protein', 'day.total_carbs', 'day.total_fat')}
         AS health_score,
       {feedback_sql('day.total_calories', 'day.total_protein',
                     'COALESCE(g.daily_calorie_goal, 2000.0)', 'COALESCE(g.daily_protein_goal, 150.0)',
                     "COALESCE(g.goal_type, 'Maintenance')")} AS ai_feedback,
       {q(nu.ANALYSIS_SUGGESTION)} AS suggestions
FROM day LEFT JOIN g ON g.member_id = day.member_id
WHERE day.member_id IN (SELECT id FROM members WHERE membership_type IN ('Premium', 'VIP'))
""", ["detected_meals", "members", "nutrition_goals"], "X17 P17 F17 F18")
def _premium_detected_foods(t):
    return nu.log_detected_foods(t.detected_meals, t.members, t.nutrition_goals, premium_only=True)


@register("meal_health_scores", f"""
SELECT member_id, log_date, meal_type,
       {health_score_sql('SUM(total_calories)', 'SUM(total_protein)', 'SUM(total_carbs)',
                         'SUM(total_fat)')} AS health_score,
       array_to_string({recommendations_sql('SUM(total_calories)', 'SUM(total_protein)',
                                            'SUM(total_carbs)', 'SUM(total_fat)')}, '|')
         AS recommendations
FROM nutrition_logs GROUP BY member_id, log_date, meal_type
""", ["nutrition_logs"], "F17 F19 A20")
def _meal_health_scores(t):
    s = t.nutrition_logs.groupBy("member_id", "log_date", "meal_type").agg(
        *[F.sum(f"total_{m}").alias(m) for m in nu.MACROS])
    return s.select("member_id", "log_date", "meal_type",
                    nfx.health_score("calories", "protein", "carbs", "fat").alias("health_score"),
                    F.array_join(nfx.food_recommendations("calories", "protein", "carbs", "fat"), "|")
                    .alias("recommendations"))


def _needs_sql():
    base = "(10.0 * weight + 6.25 * height - 5.0 * age)"
    bmr = f"CASE WHEN lower(gender) = 'male' THEN {base} + 5.0 ELSE {base} - 161.0 END"
    act = "COALESCE(" + "CASE lower(activity_level) " + " ".join(
        f"WHEN {q(k)} THEN {v}" for k, v in nfx.ACTIVITY_MULTIPLIERS.items()) + " END, 1.2)"
    adj = "COALESCE(CASE lower(goal) " + " ".join(
        f"WHEN {q(k)} THEN {v}" for k, v in nfx.GOAL_ADJUSTMENTS.items()) + " END, 1.0)"
    ratio = lambda i: "COALESCE(CASE lower(goal) " + " ".join(
        f"WHEN {q(k)} THEN {v[i]}" for k, v in nfx.MACRO_RATIOS.items()) + \
        f" END, {nfx.MACRO_RATIOS['maintenance'][i]})"
    return f"""
WITH b AS (SELECT member_id, goal, {bmr} AS bmr, activity_level FROM member_profiles),
t AS (SELECT member_id, goal, bmr, bmr * {act} AS tdee FROM b),
c AS (SELECT member_id, goal, bmr, tdee, tdee * {adj} AS cal FROM t)
SELECT member_id,
       CAST(round_even(cal, 0) AS BIGINT) AS daily_calories,
       CAST(round_even(cal * {ratio(0)} / 4.0, 0) AS BIGINT) AS daily_protein,
       CAST(round_even(cal * {ratio(1)} / 4.0, 0) AS BIGINT) AS daily_carbs,
       CAST(round_even(cal * {ratio(2)} / 9.0, 0) AS BIGINT) AS daily_fat,
       CAST(round_even(bmr, 0) AS BIGINT) AS bmr, CAST(round_even(tdee, 0) AS BIGINT) AS tdee,
       CAST(trunc(round_even(cal, 0) * 0.3 / 4) AS BIGINT) AS meal_protein
FROM c
"""


@register("nutritional_needs", _needs_sql(), ["member_profiles"], "F20 F21")
def _nutritional_needs(t):
    p = t.member_profiles
    n = nfx.nutritional_needs("age", "gender", "weight", "height", "activity_level", "goal")
    return p.select("member_id", n.alias("n")).select(
        "member_id", "n.*", nfx.meal_macros("n.daily_calories").protein.cast("long").alias("meal_protein"))
