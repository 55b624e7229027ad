"""The reference's seven sample meals, for tests only (never a registered query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sample meals (meal_type, food, quantity, calories, protein, carbs, fat).
SAMPLE_MEALS = [
    ("breakfast", "Apple", 150, 95, 0, 25, 0),
    ("breakfast", "Oatmeal", 100, 350, 12, 60, 8),
    ("lunch", "Chicken Breast", 200, 330, 62, 0, 6),
    ("lunch", "Brown Rice", 100, 110, 2, 23, 1),
    ("snack", "Greek Yogurt", 170, 130, 15, 8, 5),
    ("dinner", "Salmon", 150, 280, 34, 0, 12),
    ("dinner", "Broccoli", 100, 55, 4, 11, 0),
]


def sample_nutrition(spark: SparkSession, member_id: int = 1) -> DataFrame:
    rows = [(member_id, m[0], m[1], *[float(x) for x in m[2:]]) for m in SAMPLE_MEALS]
    return spark.createDataFrame(rows, "member_id int, meal_type string, food string, quantity double, "
                                       "calories double, protein double, carbs double, fat double")
