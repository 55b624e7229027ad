"""Nutrition analytics.

Sums of DECIMAL(7,2) are returned as DECIMAL(18,2); averages as DOUBLE
rounded to 4 places (the reference's MySQL decimals, made engine-neutral).
Facts are pre-aggregated per member (or member-day) before they meet the
member/coach bridge, so no join multiplies log rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.nutrition_fx import (DEFAULT_GOALS, health_score,
                                            nutrition_feedback)
from gymlake.functions.text import split_name
from gymlake.functions.timeutil import lit_date, week_start
from gymlake.operators.attendance import latest_n
from gymlake.operators.filters import entitled, range_start

MACROS = ("calories", "protein", "carbs", "fat")
MEAL_TYPES = ("breakfast", "lunch", "dinner", "snack")
UNITS = ("grams", "ml", "pieces", "cups", "tablespoons", "serving")
# The row logged when a photo yields no detected food.
DEFAULT_DETECTED_FOOD = {"name": "Unknown Food Item", "quantity": 100.0, "calories": 200.0,
                         "protein": 8.0, "carbs": 25.0, "fat": 8.0, "confidence": 0.3}
ANALYSIS_SUGGESTION = "Great job tracking your nutrition! Keep logging your meals for better insights."


def dsum(c) -> Column:
    return F.sum(c).cast("decimal(18,2)")


def _in_range(logs: DataFrame, time_range: str, as_of) -> DataFrame:
    lo = range_start(time_range, as_of)
    return logs if lo is None else logs.filter(F.col("log_date") >= lo)


# ---------------------------------------------------------------- A15
def member_nutrition_summary(members: DataFrame, member_coach: DataFrame,
                             logs: DataFrame) -> DataFrame:
    """Per (coach, member): entries, average calories/protein, last entry."""
    per = logs.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("nutrition_entries"),
        F.sum(F.col("total_calories").cast("double")).alias("_cal"),
        F.sum(F.col("total_protein").cast("double")).alias("_pro"),
        F.max("created_at").alias("last_nutrition_entry"))
    return (member_coach.select("coach_id", "member_id")
            .join(members.select(F.col("id").alias("member_id"), "name", "email", "membership_type"),
                  "member_id")
            .join(per, "member_id", "left")
            .select("coach_id", "member_id", "name", "email", "membership_type",
                    F.coalesce("nutrition_entries", F.lit(0)).alias("nutrition_entries"),
                    F.round(F.col("_cal") / F.col("nutrition_entries"), 4).alias("avg_calories"),
                    F.round(F.col("_pro") / F.col("nutrition_entries"), 4).alias("avg_protein"),
                    "last_nutrition_entry"))


# ---------------------------------------------------------------- A16
def coach_nutrition_stats(member_coach: DataFrame, logs: DataFrame) -> DataFrame:
    """Per coach over its members' logs.  ``entries_with_calories`` is the
    reference's ``days_with_entries`` under an honest name (D11)."""
    per = logs.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"total_{m}").cast("double")).alias(f"s_{m}") for m in MACROS],
        F.count(F.when(F.col("total_calories") > 0, 1)).alias("n_cal"))
    j = member_coach.select("coach_id", "member_id").join(per, "member_id", "left")
    total = F.sum("n")
    return j.groupBy("coach_id").agg(
        F.count_distinct("member_id").alias("total_members"),
        F.count("n").alias("members_with_nutrition"),
        F.coalesce(total, F.lit(0)).alias("total_nutrition_entries"),
        *[F.round(F.sum(f"s_{m}") / total, 4).alias(f"avg_{m}") for m in MACROS],
        F.coalesce(F.sum("n_cal"), F.lit(0)).alias("entries_with_calories"))


# ---------------------------------------------------------------- A17 / A20
def daily_nutrition(logs: DataFrame) -> DataFrame:
    """Sums per member and day."""
    return logs.groupBy("member_id", "log_date").agg(
        *[dsum(f"total_{m}").alias(m) for m in MACROS],
        F.count(F.lit(1)).alias("entries_count"))


def nutrition_trends(members: DataFrame, member_coach: DataFrame, logs: DataFrame, as_of,
                     days: int = 7) -> DataFrame:
    """Per (coach, member, day) in the last ``days`` days: averages and entry count."""
    lo = F.date_sub(lit_date(as_of), days)
    per = (logs.filter(F.col("log_date") >= lo).groupBy("member_id", "log_date").agg(
        *[F.sum(F.col(f"total_{m}").cast("double")).alias(f"s_{m}") for m in MACROS],
        F.count(F.lit(1)).alias("entries_count")))
    return (member_coach.select("coach_id", "member_id").join(per, "member_id")
            .join(members.select(F.col("id").alias("member_id"), "name"), "member_id")
            .select("coach_id", "member_id", "name", F.col("log_date").alias("date"),
                    *[F.round(F.col(f"s_{m}") / F.col("entries_count"), 4).alias(f"avg_{m}")
                      for m in MACROS],
                    "entries_count"))


# ---------------------------------------------------------------- A18 / A19
def nutrition_analytics(members: DataFrame, member_coach: DataFrame, logs: DataFrame,
                        time_range: str, as_of) -> DataFrame:
    """Per (coach, member): averages, entries, real active days (distinct log
    days), entries with calories, first/last name (F7).  With a range set the
    reference's WHERE makes the join inner (D5); with ``all`` it stays outer."""
    scoped = _in_range(logs, time_range, as_of)
    per_day = scoped.groupBy("member_id", "log_date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"total_{m}").cast("double")).alias(f"s_{m}") for m in MACROS],
        F.count(F.when(F.col("total_calories") > 0, 1)).alias("n_cal"))
    per = per_day.groupBy("member_id").agg(
        F.sum("n").alias("total_entries"), F.count(F.lit(1)).alias("active_days"),
        *[F.sum(f"s_{m}").alias(f"s_{m}") for m in MACROS],
        F.sum("n_cal").alias("entries_with_calories"))
    how = "left" if range_start(time_range, as_of) is None else "inner"
    names = split_name("name")
    return (member_coach.select("coach_id", "member_id")
            .join(members.select(F.col("id").alias("member_id"), "name"), "member_id")
            .join(per, "member_id", how)
            .select("coach_id", "member_id",
                    names.first_name.alias("first_name"), names.last_name.alias("last_name"),
                    *[F.round(F.col(f"s_{m}") / F.col("total_entries"), 4).alias(f"avg_{m}")
                      for m in MACROS],
                    F.coalesce("total_entries", F.lit(0)).alias("total_entries"),
                    F.coalesce("active_days", F.lit(0)).alias("active_days"),
                    F.coalesce("entries_with_calories", F.lit(0)).alias("entries_with_calories"))
            # one coach's members together and in order; no global sort
            .repartition("coach_id")
            .sortWithinPartitions("coach_id", F.desc_nulls_last("avg_calories"), "member_id"))


def meal_distribution(member_coach: DataFrame, logs: DataFrame, time_range: str,
                      as_of) -> DataFrame:
    """Per (coach, meal type): entries and average calories."""
    per = (_in_range(logs, time_range, as_of).groupBy("member_id", "meal_type")
           .agg(F.count(F.lit(1)).alias("n"),
                F.sum(F.col("total_calories").cast("double")).alias("s")))
    return (member_coach.select("coach_id", "member_id").join(per, "member_id")
            .groupBy("coach_id", "meal_type")
            .agg(F.sum("n").alias("count"), F.round(F.sum("s") / F.sum("n"), 4).alias("avg_calories")))


# ---------------------------------------------------------------- A21 / A22
def today_nutrition(logs: DataFrame, as_of) -> DataFrame:
    """Per member and meal type on ``as_of`` plus the day total (meal_type NULL)."""
    day = logs.filter(F.col("log_date") == lit_date(as_of))
    return (day.rollup("member_id", "meal_type")
            .agg(*[dsum(f"total_{m}").alias(m) for m in MACROS])
            .filter(F.col("member_id").isNotNull()))


def effective_goals(members: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals per member with the reference's defaults for members without a row."""
    g = members.select(F.col("id").alias("member_id")).join(goals, "member_id", "left")
    return g.select("member_id", *[
        F.coalesce(F.col(k), F.lit(v).cast("decimal(7,2)") if k != "goal_type" else F.lit(v)).alias(k)
        for k, v in DEFAULT_GOALS.items()])


def goal_progress(members: DataFrame, goals: DataFrame, logs: DataFrame, as_of) -> DataFrame:
    """today's totals against goals, percent (2 dp); a zero goal gives NULL."""
    day = (logs.filter(F.col("log_date") == lit_date(as_of)).groupBy("member_id")
           .agg(*[dsum(f"total_{m}").alias(m) for m in MACROS]))
    g = effective_goals(members, goals)
    out = g.join(day, "member_id")
    goal_col = {"calories": "daily_calorie_goal", "protein": "daily_protein_goal",
                "carbs": "daily_carbs_goal", "fat": "daily_fat_goal"}
    return out.select(
        "member_id", *MACROS,
        *[F.round(F.try_divide(F.col(m).cast("double") * 100.0, F.col(goal_col[m]).cast("double")), 2)
          .alias(f"{m}_progress") for m in MACROS])


# ---------------------------------------------------------------- X6
def weekly_nutrition(members: DataFrame, logs: DataFrame, as_of) -> DataFrame:
    """The Monday-first week containing ``as_of`` for every member, zero-filled.

    The 7-day spine is generated per member with ``sequence``; facts are summed
    per (member, day) first and left-joined on both keys.
    """
    start = week_start(lit_date(as_of))
    end = F.date_add(start, 6)
    sums = daily_nutrition(logs.filter(F.col("log_date").between(start, end)))
    spine = members.select(F.col("id").alias("member_id"),
                           F.explode(F.sequence(start, end)).alias("log_date"))
    return (spine.join(sums, ["member_id", "log_date"], "left")
            .select("member_id", F.date_format("log_date", "yyyy-MM-dd").alias("date"),
                    F.date_format("log_date", "EEEE").alias("day_name"),
                    *[F.coalesce(F.col(m), F.lit(0).cast("decimal(18,2)")).alias(m) for m in MACROS]))


# ---------------------------------------------------------------- A26
def accumulate_day(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Additive upsert of day totals keyed by (member, day) (the intended D9)."""
    cols = ["member_id", "analysis_date"] + [f"total_{m}" for m in MACROS]
    both = existing.select(*cols).unionByName(new.select(*cols))
    return both.groupBy("member_id", "analysis_date").agg(
        *[dsum(f"total_{m}").alias(f"total_{m}") for m in MACROS])


# ---------------------------------------------------------------- X17
DETECTED_SCHEMA = ("array<struct<name:string, quantity:double, calories:double, protein:double, "
                   "carbs:double, fat:double, confidence:double>>")


def detected_food_rows(detected: DataFrame) -> DataFrame:
    """X17 part 1: one log row per detected food; malformed or empty JSON -> default row."""
    d = DEFAULT_DETECTED_FOOD
    default = F.array(F.struct(*[F.lit(v).alias(k) for k, v in d.items()]))
    parsed = F.col("_parsed")  # parsed once per row, then tested and exploded
    foods = F.when(F.coalesce(F.size(parsed), F.lit(0)) <= 0, default).otherwise(parsed)
    return (detected.withColumn("_parsed", F.from_json(F.col("detected_foods"), DETECTED_SCHEMA))
            .select("id", "member_id", "meal_type", "log_date", F.posexplode(foods).alias("pos", "food"))
            .select("id", "pos", "member_id", "meal_type", "log_date",
                    F.col("food.name").alias("custom_food_name"),
                    F.col("food.quantity").alias("quantity"),
                    *[F.col(f"food.{m}").alias(f"total_{m}") for m in MACROS],
                    F.col("food.confidence").alias("ai_confidence")))


def latest_analyses(detected: DataFrame, n: int = 7) -> DataFrame:
    """The latest ``n`` meal analyses of each member, newest first: the day totals that
    detected foods add up to (A26, additive per member and day)."""
    day = (detected_food_rows(detected).groupBy("member_id", F.col("log_date").alias("analysis_date"))
           .agg(*[F.round(F.sum(f"total_{m}"), 4).alias(f"total_{m}") for m in MACROS], F.count(F.lit(1)).alias("foods")))
    return latest_n(day, "member_id", [F.desc("analysis_date")], n)


def log_detected_foods(detected: DataFrame, members: DataFrame, goals: DataFrame,
                       premium_only: bool = False) -> DataFrame:
    """Detected foods -> day totals per member with health score (F17) and feedback (F18);
    ``premium_only`` takes the meals of members whose tier unlocks the feature (P17)."""
    if premium_only:
        who = entitled(members).select(F.col("id").alias("member_id"))
        detected = detected.join(who, "member_id", "left_semi")
    rows = detected_food_rows(detected)
    day = rows.groupBy("member_id", F.col("log_date").alias("analysis_date")).agg(
        *[F.round(F.sum(f"total_{m}"), 4).alias(f"total_{m}") for m in MACROS])
    g = effective_goals(members, goals)
    return (day.join(g, "member_id", "left")
            .select("member_id", "analysis_date", *[f"total_{m}" for m in MACROS],
                    health_score("total_calories", "total_protein", "total_carbs", "total_fat")
                    .alias("health_score"),
                    nutrition_feedback("total_calories", "total_protein",
                                       F.coalesce("daily_calorie_goal", F.lit(2000.0)),
                                       F.coalesce("daily_protein_goal", F.lit(150.0)),
                                       F.coalesce("goal_type", F.lit("Maintenance")))
                    .alias("ai_feedback"),
                    F.lit(ANALYSIS_SUGGESTION).alias("suggestions")))


# ---------------------------------------------------------------- X18
def log_foods(entries: DataFrame) -> DataFrame:
    """Manual entries with a unit and meal-type check; rejected rows carry a reason.
    Stated values are stored as they are, also a stated 0."""
    reason = (F.when(~F.col("unit").isin(*UNITS), F.lit("invalid unit"))
              .when(~F.col("meal_type").isin(*MEAL_TYPES), F.lit("invalid meal type"))
              .when(F.col("quantity") <= 0, F.lit("invalid quantity")))
    return entries.withColumn("reject_reason", reason)


def log_day_totals(entries: DataFrame) -> DataFrame:
    """Day totals of the accepted entries, in the columns of stored day totals."""
    ok = log_foods(entries).filter(F.col("reject_reason").isNull())
    return ok.groupBy("member_id", F.col("log_date").alias("analysis_date")).agg(
        F.count(F.lit(1)).alias("entries"), *[dsum(f"total_{m}").alias(f"total_{m}") for m in MACROS])
