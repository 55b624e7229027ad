"""Registered queries: schema probe, constraint checks and the JSON document source."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.operators.foods import flatten_food_nutrients
from gymlake.plans.catalog import register
from gymlake.plans.q_foods import _DETAIL, _nutrient
from gymlake.operators.foods import NUTRIENT_IDS
from gymlake.session import checkpoint_dir
from gymlake.sources.contracts import check_constraints, describe_table
from gymlake.sources.json_docs import read_food_json
from gymlake.sources.schemas import SCHEMAS


_TYPES = [(f.name, f.dataType.simpleString()) for f in SCHEMAS["sessions"].fields]


# the probe's verdict per expected column; the stated types are the contract's
@register("describe_sessions", "WITH n AS (SELECT COUNT(*) AS row_count FROM sessions)\n" + " UNION ALL ".join(
    f"SELECT 'sessions' AS table_name, '{name}' AS column_name, true AS present, '{kind}' AS actual_type, "
    f"'{kind}' AS expected_type, row_count FROM n" for name, kind in _TYPES), ["sessions"], "S2")
def _describe_sessions(t):
    return describe_table(t.sessions, "sessions")


@register("check_slot_writes", """
SELECT 'availability_slots' AS table_name, 'enum' AS check_name, 'user_type' AS column_name,
       COUNT(CASE WHEN lower(user_type) NOT IN ('coach', 'member') AND user_type IS NOT NULL THEN 1 END)
         AS bad_rows
FROM slot_updates
UNION ALL
SELECT 'availability_slots', 'range', 'hour', COUNT(CASE WHEN NOT hour BETWEEN 0 AND 23 THEN 1 END)
FROM slot_updates
UNION ALL
SELECT 'availability_slots', 'unique', 'user_id,user_type,slot_date,hour', CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
FROM (SELECT COUNT(*) AS n FROM slot_updates GROUP BY user_id, user_type, slot_date, hour
      HAVING COUNT(*) > 1) d
""", ["slot_updates"], "S3")
def _check_slot_writes(t):
    return check_constraints(t.slot_updates, "availability_slots")


@register("check_member_coach", """
SELECT 'member_coach' AS table_name, 'unique' AS check_name, 'member_id,coach_id' AS column_name,
       CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS bad_rows
FROM (SELECT COUNT(*) AS n FROM member_coach GROUP BY member_id, coach_id HAVING COUNT(*) > 1) d
""", ["member_coach"], "S3")
def _check_member_coach(t):
    return check_constraints(t.member_coach, "member_coach")


@register("read_food_json", f"""
WITH d AS (SELECT from_json(detail_json, '{_DETAIL}') AS doc FROM food_docs),
n AS (
  SELECT doc.fdcId AS fdc_id, COALESCE(doc.description, '') AS food_name,
         COALESCE(doc.brandOwner, '') AS brand, COALESCE(doc.foodCategory, '') AS category,
         {', '.join(f"{_nutrient('COALESCE(doc.foodNutrients, [])', ids)} AS {k}"
                    for k, ids in NUTRIENT_IDS.items())}
  FROM d)
SELECT * REPLACE (CASE WHEN calories = 0
                       THEN CAST(round_even(protein * 4 + carbs * 4 + fat * 9, 0) AS BIGINT)
                       ELSE calories END AS calories)
FROM n
""", ["food_docs"], "S5 X14")
def _read_food_json(t):
    # the documents are written as JSON lines to the shared folder, then read back
    # through the JSON source with an explicit schema
    import uuid
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/food_json/{uuid.uuid4().hex[:10]}"
    t.food_docs.select(F.col("detail_json").alias("value")).write.mode("overwrite").text(path)
    docs = read_food_json(t.spark, path, "detail")
    return flatten_food_nutrients(docs.select(F.struct(*docs.columns).alias("detail_json")))
