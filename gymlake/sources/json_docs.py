"""JSON columns with safe parsing and defaults, and JSON document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.operators import foods

# Preference defaults when a user has none (or the JSON is missing/bad).
DEFAULT_TIME_SLOTS = ["09:00", "10:00", "11:00", "14:00", "15:00", "16:00"]
DEFAULT_DURATION = 60
DEFAULT_WEEK = {"is_available": True, "start_time": "08:00", "end_time": "20:00"}

_DOC_SCHEMAS = {"detail": foods.DETAIL_SCHEMA, "search": foods.SEARCH_SCHEMA,
                "product": foods.PRODUCT_SCHEMA}


def parse_preferences(prefs: DataFrame) -> DataFrame:
    """JSON arrays -> ``array<string>``; NULL or malformed -> defaults (six time
    slots, no workout types); an explicit ``[]`` stays empty."""
    slots = F.from_json("preferred_time_slots", "array<string>")
    types = F.from_json("preferred_workout_types", "array<string>")
    return prefs.select(
        "user_id", "user_type",
        F.coalesce(types, F.array().cast("array<string>")).alias("preferred_workout_types"),
        F.coalesce(F.col("preferred_duration"), F.lit(DEFAULT_DURATION)).alias("preferred_duration"),
        F.coalesce(slots, F.array(*[F.lit(s) for s in DEFAULT_TIME_SLOTS])).alias("preferred_time_slots"))


def with_default_preferences(users: DataFrame, prefs: DataFrame) -> DataFrame:
    """F16: every user gets a preference row; users without one get the defaults."""
    parsed = parse_preferences(prefs)
    j = users.select("user_id", "user_type").join(parsed, ["user_id", "user_type"], "left")
    return j.select(
        "user_id", "user_type",
        F.coalesce("preferred_workout_types", F.array().cast("array<string>")).alias("preferred_workout_types"),
        F.coalesce("preferred_duration", F.lit(DEFAULT_DURATION)).alias("preferred_duration"),
        F.coalesce("preferred_time_slots", F.array(*[F.lit(s) for s in DEFAULT_TIME_SLOTS]))
        .alias("preferred_time_slots"))


def read_food_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read food-database documents (JSON lines) with an explicit schema; a
    malformed line becomes a NULL record, never a failed job."""
    schema = T._parse_datatype_string(_DOC_SCHEMAS[kind])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
