"""Domain tables derived from the driver's TPC-H-style Parquet tables.

Each derivation is one SQL text that runs unchanged in Spark and in DuckDB, so
the Spark jobs and the DuckDB oracle start from identical rows.  ``{name}``
placeholders are resolved to DataFrames on the Spark side (``spark.sql`` with
keyword DataFrames) and to view / CTE names on the DuckDB side.  The few
engine-specific fragments are ``@TOKEN@`` markers replaced per engine.
"""

from __future__ import annotations

import re

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Reporting dates used by the test queries (the reference reads the clock).
SESSION_AS_OF = "2024-01-25"
NUTRITION_AS_OF = "2001-06-30"
SESSION_NOW = "2024-01-25 10:30:00"

_NL = "chr(10)"

FIXTURE_SQL: dict[str, str] = {
    "gyms": """
SELECT n.n_nationkey AS id, n.n_name AS name, lower(n.n_name) || '@gym.test' AS email,
       r.r_name AS address
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
""",
    "coaches": """
SELECT CAST(s_suppkey AS INT) AS id, s_nationkey AS gym_id, s_name AS name,
       lower(replace(s_name, '#', '')) || '@coach.test' AS email,
       CASE s_suppkey % 3 WHEN 0 THEN 'Strength' WHEN 1 THEN 'Cardio' ELSE 'Yoga' END AS specialization,
       CASE WHEN s_suppkey % 7 = 0 THEN 'Inactive' ELSE 'Active' END AS status
FROM {supplier}
""",
    "members": """
SELECT CAST(c_custkey AS INT) AS id, c_nationkey AS gym_id, c_name AS name,
       lower(replace(c_name, '#', '')) || '@member.test' AS email,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'VIP'
            WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'Premium'
            ELSE 'Basic' END AS membership_type,
       DATE '2023-11-27' + CAST(c_custkey % 60 AS INT) AS join_date
FROM {customer}
""",
    "member_coach": """
SELECT CAST(c_custkey AS INT) AS member_id, CAST(c_custkey % 10 AS INT) AS coach_id,
       DATE '2023-11-27' + CAST(c_custkey % 60 AS INT) AS assigned_date
FROM {customer}
UNION ALL
SELECT CAST(c_custkey AS INT) AS member_id, CAST((c_custkey + 3) % 10 AS INT) AS coach_id,
       DATE '2023-12-01' + CAST(c_custkey % 30 AS INT) AS assigned_date
FROM {customer} WHERE c_custkey % 5 = 0
""",
    "sessions": f"""
SELECT e.event_id AS id, CAST(e.user_id AS INT) AS member_id, CAST(s.s_suppkey AS INT) AS coach_id,
       s.s_nationkey AS gym_id, CAST(e.ts AS DATE) AS session_date,
       lpad(CAST(hour(e.ts) AS STRING), 2, '0') || ':' || lpad(CAST(minute(e.ts) AS STRING), 2, '0')
         AS session_time,
       CAST(CASE WHEN e.event_id % 97 = 0 THEN 0 ELSE 30 + 15 * (e.event_id % 5) END AS INT) AS duration,
       CASE WHEN e.event_type IN ('purchase', 'click', 'view') THEN 'Completed'
            WHEN e.event_type = 'error' THEN 'Cancelled' ELSE 'Scheduled' END AS status,
       CASE e.event_id % 5
         WHEN 0 THEN CAST(NULL AS STRING)
         WHEN 1 THEN 'Push Workout:' || {_NL} || 'Bench Press'
         ELSE 'Workout Type: ' || CASE e.event_id % 3 WHEN 0 THEN 'Push' WHEN 1 THEN 'Core'
                                   ELSE 'Full Body' END
              || {_NL} || 'Exercises:' || {_NL} || '1. Squat' || {_NL} || '2. Plank' || {_NL}
              || {_NL} || 'Stay hydrated'
       END AS notes,
       e.ts AS created_at
FROM {{events}} e
JOIN {{supplier}} s
  ON s.s_suppkey = CASE WHEN e.event_id % 6 = 0 THEN (e.user_id + 3) % 10 ELSE e.user_id % 10 END
""",
    "nutrition_logs": """
SELECT CAST(o.o_custkey AS INT) AS member_id,
       CASE l.l_linenumber % 4 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner'
            ELSE 'snack' END AS meal_type,
       l.l_partkey AS food_item_id,
       CASE WHEN l.l_partkey % 3 = 0 THEN CAST(NULL AS STRING)
            ELSE 'custom ' || CAST(l.l_partkey AS STRING) END AS custom_food_name,
       CAST(l.l_quantity AS DECIMAL(7,2)) AS quantity, 'grams' AS unit,
       CAST(floor(l.l_extendedprice / 100) AS DECIMAL(7,2)) AS total_calories,
       CAST(floor(l.l_quantity * 2) AS DECIMAL(7,2)) AS total_protein,
       CAST(l.l_partkey % 200 AS DECIMAL(7,2)) AS total_carbs,
       CAST(l.l_suppkey % 60 AS DECIMAL(7,2)) AS total_fat,
       l.l_shipdate AS created_at, CAST(l.l_shipdate AS DATE) AS log_date
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""",
    "food_items": """
SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category,
       CAST(floor(p_retailprice / 10) AS DECIMAL(7,2)) AS calories_per_100g,
       CAST(p_size AS DECIMAL(7,2)) AS protein_per_100g
FROM {part}
""",
    "payments": """
SELECT o.o_orderkey AS id, CAST(o.o_custkey AS INT) AS member_id, c.c_nationkey AS gym_id,
       CAST(o.o_totalprice AS DECIMAL(10,2)) AS amount, o.o_orderdate AS payment_date,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Membership' WHEN 1 THEN 'Session' ELSE 'Other' END
         AS payment_type,
       CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Failed' END
         AS status
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
""",
    "messages": """
SELECT cv.conv_id * 1000 + cv.turn AS id, cv.turn AS seq, cv.conv_id,
       CAST(CASE cv.role WHEN 'user' THEN cv.conv_id % 100 WHEN 'assistant' THEN cv.conv_id % 10
            ELSE c.c_nationkey END AS INT) AS sender_id,
       CASE cv.role WHEN 'user' THEN 'member' WHEN 'assistant' THEN 'coach' ELSE 'gym' END
         AS sender_type,
       CAST(CASE cv.role WHEN 'user' THEN cv.conv_id % 10 ELSE cv.conv_id % 100 END AS INT)
         AS receiver_id,
       CASE cv.role WHEN 'user' THEN 'coach' ELSE 'member' END AS receiver_type,
       cv.text AS message
FROM {conversations} cv JOIN {customer} c ON c.c_custkey = cv.conv_id % 100
""",
    "all_users": """
SELECT id, 'member' AS user_type, name, gym_id FROM {members}
UNION ALL
SELECT id, 'coach' AS user_type, name, gym_id FROM {coaches}
""",
    "free_days": """
SELECT id AS user_id, user_type,
       CASE dow WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday'
                WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday'
                ELSE 'Sunday' END AS day_of_week,
       (id + dow) % 7 <> 0 AS is_available,
       lpad(CAST(8 + id % 3 AS STRING), 2, '0') || ':00' AS start_time,
       lpad(CAST(20 - id % 4 AS STRING), 2, '0') || ':00' AS end_time
FROM (SELECT id, user_type, @SEQ_0_6@ AS dow FROM {all_users} WHERE id % 11 <> 10) u
""",
    "slot_updates": """
SELECT CAST(user_id AS INT) AS user_id, 'member' AS user_type, CAST(ts AS DATE) AS slot_date,
       CAST(hour(ts) AS INT) AS hour, event_id % 2 = 0 AS is_available, event_id AS seq,
       ts AS updated_at
FROM {events}
""",
    "availability_slots": """
SELECT user_id, user_type, slot_date, hour, is_available, seq, updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, user_type, slot_date, hour
                                   ORDER BY seq DESC) AS rn
      FROM {slot_updates}) t
WHERE rn = 1
""",
    "user_preferences": """
SELECT id AS user_id, user_type,
       CASE id % 4 WHEN 0 THEN '["Strength","Cardio"]' WHEN 1 THEN '["Yoga"]'
                   WHEN 2 THEN CAST(NULL AS STRING) ELSE 'not json' END AS preferred_workout_types,
       CASE WHEN id % 2 = 0 THEN 60 ELSE 45 END AS preferred_duration,
       CASE WHEN id % 5 = 0 THEN CAST(NULL AS STRING)
            WHEN id % 13 = 0 THEN '["09:00"'
            WHEN id % 3 = 0 THEN '["09:00","10:00"]'
            WHEN id % 3 = 1 THEN '["18:00"]'
            ELSE '[]' END AS preferred_time_slots
FROM {all_users}
WHERE id % 7 <> 6
""",
    "nutrition_goals": """
SELECT id AS member_id,
       CAST(1800 + 100 * (id % 5) AS DECIMAL(7,2)) AS daily_calorie_goal,
       CAST(120 + 10 * (id % 4) AS DECIMAL(7,2)) AS daily_protein_goal,
       CAST(250 AS DECIMAL(7,2)) AS daily_carbs_goal,
       CAST(70 AS DECIMAL(7,2)) AS daily_fat_goal,
       CASE id % 4 WHEN 0 THEN 'Weight_Loss' ELSE 'Muscle_Gain' END AS goal_type
FROM {members}
WHERE id % 2 = 0
""",
    "nutrition_plans": """
SELECT o_orderkey AS id, CAST(o_custkey AS INT) AS member_id, CAST(o_custkey % 10 AS INT) AS coach_id,
       'Plan ' || CAST(o_orderkey AS STRING) AS plan_name,
       CASE WHEN o_orderkey % 49 = 0 THEN '{"meal_plan": {"day_1": '
       ELSE '{"meal_plan": {"day_1": {"breakfast": {"name": "Oats ' || CAST(o_orderkey % 10 AS STRING)
            || '", "ingredients": ["oats", "milk"], "nutrition": {"calories": '
            || CAST(300 + o_orderkey % 100 AS STRING) || ', "protein": 12, "carbs": 50, "fat": 6}}, '
            || '"lunch": {"name": "Rice bowl", "ingredients": ["rice", "chicken", "peas"], '
            || '"nutrition": {"calories": 650, "protein": 40, "carbs": 80, "fat": 15}}}, '
            || '"day_2": {"dinner": {"name": "Salmon ' || o_orderpriority || '", "ingredients": '
            || '["salmon", "rice"], "nutrition": {"calories": 550, "protein": 35, "carbs": 40, '
            || '"fat": 20}}}}, "shopping_list": ["oats", "milk", "rice"]}'
       END AS plan_data,
       CAST(1600 + 100 * (o_orderkey % 10) AS INT) AS daily_calories,
       CAST(100 + 5 * (o_orderkey % 10) AS INT) AS daily_protein,
       CAST(200 + 10 * (o_orderkey % 5) AS INT) AS daily_carbs,
       CAST(50 + 2 * (o_orderkey % 5) AS INT) AS daily_fat,
       o_orderstatus = 'O' AS is_active, o_orderdate AS created_at
FROM {orders}
""",
    "member_plan_selections": """
SELECT member_id, min(id) AS selected_plan_id, false AS is_default
FROM {nutrition_plans}
WHERE member_id % 4 = 0
GROUP BY member_id
""",
    "order_booking_requests": """
SELECT o_orderkey AS request_id, CAST(o_custkey % 10 AS INT) AS coach_id,
       CAST(o_custkey AS INT) AS member_id,
       DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS session_date,
       lpad(CAST(8 + o_orderkey % 12 AS STRING), 2, '0') || ':00' AS session_time,
       60 AS duration
FROM {orders}
""",
    "booking_requests": """
SELECT request_id, coach_id, member_id, session_date, session_time, duration FROM {order_booking_requests}
UNION ALL
SELECT id + 1000000000 AS request_id, coach_id, member_id, session_date, session_time, duration
FROM {sessions}
""",    "member_profiles": """
SELECT CAST(c_custkey AS INT) AS member_id, CAST(18 + c_custkey % 50 AS INT) AS age,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
       CAST(50 + c_custkey % 60 AS DOUBLE) AS weight, CAST(150 + c_custkey % 45 AS DOUBLE) AS height,
       CASE c_custkey % 6 WHEN 0 THEN 'sedentary' WHEN 1 THEN 'lightly_active'
            WHEN 2 THEN 'moderately_active' WHEN 3 THEN 'very_active'
            WHEN 4 THEN 'extremely_active' ELSE 'unknown' END AS activity_level,
       CASE c_custkey % 4 WHEN 0 THEN 'weight_loss' WHEN 1 THEN 'muscle_gain'
            WHEN 2 THEN 'maintenance' ELSE 'Weight_Loss' END AS goal
FROM {customer}
""",
    "detected_meals": """
SELECT o_orderkey AS id, CAST(o_custkey AS INT) AS member_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner'
            ELSE 'snack' END AS meal_type,
       CAST(o_orderdate AS DATE) AS log_date,
       CASE WHEN o_orderkey % 25 = 0 THEN '[]'
            WHEN o_orderkey % 35 = 0 THEN 'not json'
            ELSE '[{"name": "food ' || CAST(o_orderkey % 50 AS STRING) || '", "quantity": 100, '
                 || '"calories": ' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING)
                 || ', "protein": ' || CAST(o_orderkey % 40 AS STRING)
                 || ', "carbs": ' || CAST(o_orderkey % 60 AS STRING)
                 || ', "fat": ' || CAST(o_orderkey % 20 AS STRING)
                 || ', "confidence": 0.' || CAST(5 + o_orderkey % 5 AS STRING) || '}, '
                 || '{"name": "apple", "quantity": 150, "calories": 95, "protein": 0, "carbs": 25, '
                 || '"fat": 0, "confidence": 0.9}]'
       END AS detected_foods,
       '[{"name": "' || CASE o_orderkey % 3 WHEN 0 THEN 'banana' WHEN 1 THEN 'pizza' ELSE 'cake' END
         || '", "confidence": 0.' || CAST(1 + o_orderkey % 9 AS STRING)
         || ', "class_id": ' || CAST(46 + o_orderkey % 10 AS STRING)
         || ', "is_food": true, "box": {"x1": 0, "y1": 0, "x2": 10, "y2": 10}}, '
         || '{"name": "person", "confidence": 0.95, "class_id": 0, "is_food": false, '
         || '"box": {"x1": 1, "y1": 1, "x2": 5, "y2": 5}}, '
         || '{"name": "dining table", "confidence": 0.' || CAST(2 + o_orderkey % 7 AS STRING)
         || ', "class_id": 60, "is_food": false, "box": {"x1": 2, "y1": 2, "x2": 8, "y2": 8}}]'
         AS detections
FROM {orders}
""",
    "bulk_requests": """
SELECT o_orderkey AS request_id, CAST(o_custkey % 150 AS INT) AS user_id, 'member' AS user_type,
       DATE '2024-01-01' + CAST(o_orderkey % 25 AS INT) AS start_date,
       DATE '2024-01-01' + CAST(o_orderkey % 25 + o_orderkey % 3 AS INT) AS end_date,
       CAST(6 + o_orderkey % 10 AS INT) AS start_hour,
       CAST(6 + o_orderkey % 10 + o_orderkey % 4 AS INT) AS end_hour,
       o_orderkey % 2 = 1 AS is_available, o_orderkey AS seq
FROM {orders}
""",
    "member_imports": """
SELECT c_custkey + 100000 AS import_id, c_nationkey AS gym_id,
       CASE WHEN c_custkey % 36 = 0 THEN CAST(NULL AS STRING) ELSE c_name || ' Jr' END AS name,
       CASE WHEN c_custkey % 20 = 0 THEN 'no-at-sign.test'
            WHEN c_custkey % 12 = 0 THEN lower(replace(c_name, '#', '')) || '@member.test'
            WHEN c_custkey % 28 = 0 THEN 'dup' || CAST(c_custkey % 3 AS STRING) || '@import.test'
            ELSE 'new' || CAST(c_custkey AS STRING) || '@import.test' END AS email,
       CASE WHEN c_custkey % 16 = 0 THEN 'Gold'
            WHEN c_mktsegment = 'MACHINERY' THEN 'vip'
            ELSE 'Basic' END AS membership_type,
       CAST(c_custkey % 13 AS INT) AS coach_id
FROM {customer}
""",
    "food_docs": """
SELECT p_partkey AS doc_id, p_name AS query_name, CAST(p_partkey AS STRING) AS barcode,
       '{"fdcId": ' || CAST(p_partkey AS STRING) || ', "description": "' || p_name
       || '", "brandOwner": "' || p_brand || '", "foodCategory": "' || p_type || '", "foodNutrients": ['
       || '{"nutrient": {"id": ' || CASE WHEN p_partkey % 2 = 0 THEN '1003' ELSE '203' END
       || ', "name": "Protein"}, "amount": ' || CAST(p_size AS STRING) || '.'
       || CAST(p_partkey % 10 AS STRING) || '}, '
       || '{"nutrient": {"id": 1004, "name": "Total lipid (fat)"}, "amount": '
       || CAST(p_partkey % 30 AS STRING) || '.5}, '
       || '{"nutrient": {"id": 205, "name": "Carbohydrate"}, "amount": '
       || CAST(p_partkey % 70 AS STRING) || '.25}, '
       || '{"nutrient": {"id": 291, "name": "Fiber"}, "amount": ' || CAST(p_partkey % 9 AS STRING) || '}, '
       || '{"nutrient": {"id": 307, "name": "Sodium"}, "amount": ' || CAST(p_partkey % 400 AS STRING) || '}'
       || CASE WHEN p_partkey % 4 = 0 THEN ''
               ELSE ', {"nutrient": {"id": 208, "name": "Energy"}, "amount": '
                    || CAST(CAST(floor(p_retailprice / 5) AS BIGINT) AS STRING) || '}' END
       || CASE WHEN p_partkey % 6 = 0 THEN ', {"nutrient": {"id": 203, "name": "Protein"}, "amount": 1.5}'
               ELSE '' END
       || ']}' AS detail_json,
       '{"foods": [{"fdcId": ' || CAST(p_partkey * 10 AS STRING) || ', "description": "' || p_name
       || ' raw", "brandOwner": "' || p_brand || '", "foodNutrients": [{"nutrientId": 203, "value": '
       || CAST(p_size AS STRING) || '}'
       || CASE WHEN p_partkey % 3 = 0 THEN ', {"nutrientId": 208, "value": 0}'
               ELSE ', {"nutrientId": 208, "value": ' || CAST(p_size * 9 AS STRING) || '}' END
       || ']}, {"fdcId": ' || CAST(p_partkey * 10 + 1 AS STRING) || ', "description": "' || p_name
       || ' cooked", "brandOwner": "' || p_brand || '", "foodNutrients": [{"nutrientId": 203, "value": '
       || CAST(p_size + 1 AS STRING) || '}, {"nutrientId": 204, "value": 3}, '
       || '{"nutrientId": 205, "value": 20}, {"nutrientId": 208, "value": '
       || CAST(100 + p_partkey % 50 AS STRING) || '}]}]}' AS search_json,
       '{"status": ' || CASE WHEN p_partkey % 10 = 0 THEN '0' ELSE '1' END
       || ', "product": {"product_name": "' || p_name || '", "brands": "' || p_brand
       || '", "image_url": "img/' || CAST(p_partkey AS STRING) || '.jpg", "nutriments": '
       || '{"energy-kcal_100g": ' || CAST(CAST(floor(p_retailprice / 4) AS BIGINT) AS STRING)
       || ', "proteins_100g": ' || CAST(p_size AS STRING)
       || ', "carbohydrates_100g": ' || CAST(p_partkey % 80 AS STRING) || '}}}' AS product_json
FROM {part}
""",
    "drifted_food_docs": """
SELECT doc_id, barcode,
       CASE doc_id % 8
         WHEN 1 THEN replace(detail_json, '"name": "Protein"}, "amount": ', '"name": "Protein"}, "amount": [], "was": ')
         WHEN 2 THEN replace(detail_json, '"id": 1004', '"id": "1004"')
         WHEN 3 THEN replace(detail_json, '"foodNutrients": [', '"foodNutrients": [null, 7, "x", ')
         WHEN 4 THEN replace(detail_json, '"description": ', '"description": 12, "title": ')
         WHEN 5 THEN replace(detail_json, '"fdcId": ', '"fdcId": "F", "old": ')
         WHEN 6 THEN replace(detail_json, '"amount": ' || CAST(doc_id % 30 AS STRING) || '.5}',
                             '"amount": "' || CAST(doc_id % 30 AS STRING) || '.5"}')
         WHEN 7 THEN substr(detail_json, 1, 40)
         ELSE detail_json END AS detail_json,
       CASE doc_id % 6
         WHEN 1 THEN replace(search_json, '{"nutrientId": 208, ', '{"nutrientId": "208", ')
         WHEN 2 THEN replace(search_json, '{"foods": [', '{"foods": [17, null, ')
         WHEN 3 THEN replace(search_json, '"brandOwner": "', '"brandOwner": {"x": 1}, "owner": "')
         WHEN 4 THEN substr(search_json, 1, 60)
         ELSE search_json END AS search_json,
       CASE doc_id % 5
         WHEN 1 THEN replace(product_json, '"energy-kcal_100g": ', '"energy-kcal_100g": "7.5", "kcal": ')
         WHEN 2 THEN replace(product_json, '"status": 1', '"status": "1"')
         WHEN 3 THEN replace(product_json, '"proteins_100g": ', '"proteins_100g": {"v": 1}, "p": ')
         WHEN 4 THEN replace(product_json, '"brands": "', '"brands": ["a"], "b": "')
         ELSE product_json END AS product_json
FROM {food_docs}
""",
    "drifted_plans": """
SELECT id, member_id,
       CASE id % 5
         WHEN 1 THEN replace(plan_data, '"calories": ', '"calories": "high", "kcal": ')
         WHEN 2 THEN replace(plan_data, '["oats", "milk"], "nutrition"', '"oats, milk", "nutrition"')
         WHEN 3 THEN replace(plan_data, '"day_2": ', '"day_0": 7, "day_2": ')
         WHEN 4 THEN replace(plan_data, '"shopping_list": [', '"shopping_list": [null, {"x": 1}, 5, ')
         ELSE plan_data END AS plan_data
FROM {nutrition_plans}
""",
    "plan_selection_updates": """
SELECT member_id,
       CASE WHEN id % 35 = 0 THEN CAST(NULL AS BIGINT) WHEN id % 5 = 0 THEN id + 7 ELSE id END
         AS selected_plan_id,
       id AS seq
FROM {nutrition_plans}
""",
    "feedback_requests": """
SELECT o_orderkey AS feedback_id,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 10 ELSE (o_custkey + 1) % 10 END AS INT)
         AS coach_id,
       CAST(o_custkey AS INT) AS member_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'meal' ELSE 'goal' END AS feedback_type,
       CASE WHEN o_orderkey % 26 = 0 THEN '   ' ELSE 'Keep going, ' || o_orderpriority END AS message,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 5 + 1 AS INT) END
         AS rating
FROM {orders}
""",
    "stored_preferences": """
SELECT user_id, user_type, preferred_duration, TIMESTAMP '2023-11-01 08:00:00' AS created_at FROM {user_preferences}
""",
    "preference_updates": """
SELECT id AS user_id, user_type, CASE WHEN id % 3 = 0 THEN 90 ELSE 30 END + 15 * n AS preferred_duration,
       TIMESTAMP '2024-01-20 09:00:00' AS created_at, CAST(n + 1 AS BIGINT) AS seq
FROM (SELECT id, user_type, 0 AS n FROM {all_users} UNION ALL SELECT id, user_type, 1 AS n FROM {all_users}) u
""",
    "week_updates": """
SELECT id AS user_id, user_type, CASE id % 3 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Friday' ELSE 'Sunday' END AS day_of_week,
       id % 2 = 0 AS is_available, '07:00' AS start_time, '11:00' AS end_time, CAST(id AS BIGINT) AS seq
FROM {all_users}
""",
    "coach_delete_requests": """
SELECT CAST(s_suppkey AS INT) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE s_nationkey + 1 END AS gym_id
FROM {supplier}
""",
    "meal_logs": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, CAST(o.o_custkey AS INT) AS member_id, 'lunch' AS meal_type,
       'food ' || CAST(l.l_partkey AS STRING) AS custom_food_name, 'grams' AS unit,
       CAST(l.l_quantity AS DECIMAL(7,2)) AS quantity,
       CAST(floor(l.l_extendedprice / 100) AS DECIMAL(7,2)) AS total_calories,
       CAST(floor(l.l_quantity * 2) AS DECIMAL(7,2)) AS total_protein,
       CAST(l.l_partkey % 200 AS DECIMAL(7,2)) AS total_carbs, CAST(l.l_suppkey % 60 AS DECIMAL(7,2)) AS total_fat
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""",
    "meal_patches": """
SELECT id, CASE WHEN id % 7 = 0 THEN member_id + 1 ELSE member_id END AS member_id, 'dinner' AS meal_type,
       CASE WHEN id % 11 = 0 THEN CAST(NULL AS STRING) ELSE 'corrected ' || CAST(n AS STRING) END AS custom_food_name,
       CASE WHEN id % 5 = 0 THEN 'kg' ELSE 'pieces' END AS unit, CAST(quantity + n AS DECIMAL(7,2)) AS quantity,
       CAST(total_calories + n AS DECIMAL(7,2)) AS total_calories, total_protein, total_carbs, total_fat,
       CAST(n AS BIGINT) * 1000000000000 + CAST(total_calories * 100 AS BIGINT) * 100000 + CAST(quantity * 100 AS BIGINT) AS seq
FROM (SELECT *, 1 AS n FROM {meal_logs} UNION ALL SELECT *, 2 AS n FROM {meal_logs}) p
""",
    "coach_imports": """
SELECT s_suppkey + 5000 AS import_id, s_nationkey AS gym_id,
       CASE WHEN s_suppkey % 9 = 0 THEN CAST(NULL AS STRING) ELSE s_name || ' II' END AS name,
       CASE WHEN s_suppkey % 10 = 0 THEN 'no-at-sign.test'
            WHEN s_suppkey % 6 = 0 THEN lower(replace(s_name, '#', '')) || '@coach.test'
            WHEN s_suppkey % 4 = 0 THEN 'dup' || CAST(s_suppkey % 5 AS STRING) || '@import.test'
            ELSE 'coach' || CAST(s_suppkey AS STRING) || '@import.test' END AS email,
       'Yoga' AS specialization
FROM {supplier}
""",
    "plan_requests": """
SELECT o_orderkey AS request_id,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 10 ELSE (o_custkey + 1) % 10 END AS INT) AS coach_id,
       CAST(o_custkey AS INT) AS member_id, 'Plan ' || o_orderpriority AS plan_name,
       CAST(1500 + o_orderkey % 700 AS INT) AS daily_calories
FROM {orders}
""",
    "plan_update_requests": """
SELECT id AS plan_id, CAST(CASE WHEN id % 3 = 0 THEN (coach_id + 1) % 10 ELSE coach_id END AS INT) AS coach_id,
       CASE WHEN id % 13 = 0 THEN CAST(NULL AS STRING) WHEN id % 17 = 0 THEN '' ELSE 'Revised ' || CAST(n AS STRING) END AS plan_name,
       daily_calories + 10 * n AS daily_calories, CASE WHEN (id + n) % 7 = 0 THEN 0 ELSE daily_protein + n END AS daily_protein,
       daily_carbs + n AS daily_carbs, daily_fat + n AS daily_fat, CAST(n AS BIGINT) AS seq
FROM (SELECT *, 1 AS n FROM {nutrition_plans} UNION ALL SELECT *, 2 AS n FROM {nutrition_plans}) p
""",
    "plan_delete_requests": """
SELECT id AS plan_id, CAST(CASE WHEN id % 4 = 1 THEN coach_id ELSE (coach_id + 1) % 10 END AS INT) AS coach_id
FROM {nutrition_plans}
""",
    "message_delete_requests": """
SELECT id, CASE WHEN id % 3 = 0 THEN sender_id ELSE sender_id + 1 END AS sender_id,
       CASE WHEN id % 5 = 0 THEN 'gym' ELSE sender_type END AS sender_type
FROM {messages}
""",
    "slot_delete_requests": """
SELECT user_id, user_type, slot_date, CASE WHEN seq % 2 = 0 THEN hour ELSE hour + 24 END AS hour
FROM {availability_slots}
""",
    "repeated_booking_requests": """
SELECT request_id, coach_id, member_id, session_date, session_time, duration FROM {booking_requests}
UNION ALL
SELECT request_id, coach_id, member_id, session_date, session_time, duration FROM {order_booking_requests}
UNION ALL
SELECT request_id, coach_id, member_id, session_date, '07:00' AS session_time, duration FROM {order_booking_requests}
""",
    "workout_requests": """
SELECT request_id, coach_id, member_id, session_date, session_time, duration,
       CASE request_id % 3 WHEN 0 THEN 'Push' WHEN 1 THEN 'Core' ELSE 'Full Body' END AS workout_type,
       request_id % 4 AS n_exercises,
       CASE WHEN request_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN request_id % 5 = 1 THEN '' ELSE 'Warm up' END AS notes
FROM {booking_requests}
""",
    "food_entries": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS entry_key, CAST(o.o_custkey AS INT) AS member_id,
       CASE l.l_linenumber % 5 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner'
            WHEN 3 THEN 'snack' ELSE 'brunch' END AS meal_type,
       CASE l.l_linenumber WHEN 1 THEN 'grams' WHEN 2 THEN 'ml' WHEN 3 THEN 'pieces' WHEN 4 THEN 'cups'
            WHEN 5 THEN 'tablespoons' WHEN 6 THEN 'serving' ELSE 'kg' END AS unit,
       CAST(l.l_quantity AS DECIMAL(7,2)) AS quantity,
       CAST(CASE WHEN l.l_partkey % 7 = 0 THEN 0 ELSE floor(l.l_extendedprice / 100) END AS DECIMAL(7,2))
         AS total_calories,
       CAST(floor(l.l_quantity * 2) AS DECIMAL(7,2)) AS total_protein,
       CAST(l.l_partkey % 200 AS DECIMAL(7,2)) AS total_carbs,
       CAST(l.l_suppkey % 60 AS DECIMAL(7,2)) AS total_fat,
       CAST(l.l_shipdate AS DATE) AS log_date
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""",
}

_ENGINE_TOKENS = {
    "spark": {"@SEQ_0_6@": "explode(sequence(0, 6))"},
    "duckdb": {"@SEQ_0_6@": "CAST(unnest(generate_series(0, 6)) AS INT)"},
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def deps(name: str) -> list[str]:
    """Table names (raw or domain) a fixture reads."""
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def render(name: str, engine: str) -> str:
    sql = FIXTURE_SQL[name]
    for token, text in _ENGINE_TOKENS[engine].items():
        sql = sql.replace(token, text)
    return sql


def closure(names) -> list[str]:
    """Domain tables needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in RAW_TABLES or n in out:
            return
        for d in deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duckdb_cte(names) -> str:
    """``WITH a AS (...), b AS (...)`` prefix giving DuckDB the same domain tables."""
    parts = []
    for n in closure(names):
        body = _PLACEHOLDER.sub(lambda m: m.group(1), render(n, "duckdb"))
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
