"""The domain schema contract (one StructType per table) and enum domains."""

from __future__ import annotations

from pyspark.sql import types as T

I, L, S, D, TS, B = (T.IntegerType(), T.LongType(), T.StringType(), T.DateType(),
                     T.TimestampNTZType(), T.BooleanType())


def dec(p, s):
    return T.DecimalType(p, s)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Table schemas of the domain model (ids supplied, not generated).
SCHEMAS = {
    "gyms": _struct(("id", I), ("name", S), ("email", S), ("address", S)),
    "coaches": _struct(("id", I), ("gym_id", I), ("name", S), ("email", S), ("specialization", S),
                       ("status", S)),
    "members": _struct(("id", I), ("gym_id", I), ("name", S), ("email", S), ("membership_type", S),
                       ("join_date", D)),
    "member_coach": _struct(("member_id", I), ("coach_id", I), ("assigned_date", D)),
    "sessions": _struct(("id", L), ("member_id", I), ("coach_id", I), ("gym_id", I),
                        ("session_date", D), ("session_time", S), ("duration", I), ("status", S),
                        ("notes", S), ("created_at", TS)),
    "nutrition_logs": _struct(("member_id", I), ("meal_type", S), ("food_item_id", L),
                              ("custom_food_name", S), ("quantity", dec(7, 2)), ("unit", S),
                              ("total_calories", dec(7, 2)), ("total_protein", dec(7, 2)),
                              ("total_carbs", dec(7, 2)), ("total_fat", dec(7, 2)),
                              ("created_at", TS), ("log_date", D)),
    "availability_slots": _struct(("user_id", I), ("user_type", S), ("slot_date", D), ("hour", I),
                                  ("is_available", B), ("seq", L), ("updated_at", TS)),
    "free_days": _struct(("user_id", I), ("user_type", S), ("day_of_week", S), ("is_available", B),
                         ("start_time", S), ("end_time", S)),
}

# Enum domains (canonical spelling; inputs are matched case-insensitively).
ENUMS = {
    ("coaches", "status"): ("Active", "Inactive"),
    ("coaches", "role_level"): ("Junior Coach", "Senior Coach", "Head Coach", "Personal Trainer",
                                "Specialist"),
    ("members", "membership_type"): ("Basic", "Premium", "VIP"),
    ("sessions", "status"): ("Scheduled", "Completed", "Cancelled"),
    ("nutrition_logs", "meal_type"): ("breakfast", "lunch", "dinner", "snack"),
    ("nutrition_logs", "unit"): ("grams", "ml", "pieces", "cups", "tablespoons", "serving"),
    ("availability_slots", "user_type"): ("coach", "member"),
    ("free_days", "user_type"): ("coach", "member"),
    ("free_days", "day_of_week"): ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                                   "Saturday", "Sunday"),
}

# Unique keys and range checks declared by the schema.
UNIQUE_KEYS = {
    "member_coach": ("member_id", "coach_id"),
    "availability_slots": ("user_id", "user_type", "slot_date", "hour"),
    "free_days": ("user_id", "user_type", "day_of_week"),
    "members": ("email",),
    "coaches": ("email",),
}
RANGES = {("availability_slots", "hour"): (0, 23)}
