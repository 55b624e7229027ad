"""Nutrition scores, rule-based texts and needs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(c) -> Column:
    return _c(c).cast("double")


def num_or_zero(c) -> Column:
    """null-safe numeric conversion."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0))


def health_score(calories, protein, carbs, fat) -> Column:
    """macro balance score 0..10 (1 dp, half-even); 5.0 with no macros or no calories.

    Ideal energy shares: protein 25 %, carbs 55 %, fat 27.5 %.
    """
    cal, p, c, f = _d(calories), _d(protein), _d(carbs), _d(fat)
    p_pct = F.try_divide(p * 4.0, cal) * 100.0
    c_pct = F.try_divide(c * 4.0, cal) * 100.0
    f_pct = F.try_divide(f * 9.0, cal) * 100.0
    p_s = F.greatest(F.lit(0.0), 10.0 - F.abs(25.0 - p_pct) / 2.5)
    c_s = F.greatest(F.lit(0.0), 10.0 - F.abs(55.0 - c_pct) / 5.0)
    f_s = F.greatest(F.lit(0.0), 10.0 - F.abs(27.5 - f_pct) / 2.75)
    score = F.bround((p_s + c_s + f_s) / 3.0, 1)
    no_macros = F.coalesce(p + c + f, F.lit(0.0)) == 0.0
    return F.when(no_macros | cal.isNull() | (cal == 0.0), F.lit(5.0)).otherwise(score)


# Feedback sentences and the advice per goal type.
FEEDBACK_CALORIES = [
    "You're off to a good start today!",
    "You're making great progress toward your daily goals!",
    "You're almost at your calorie target for today!",
    "You've reached your calorie goal - well done!",
]
FEEDBACK_PROTEIN_LOW = "Consider adding more protein-rich foods to your next meal."
FEEDBACK_PROTEIN_HIGH = "Excellent protein intake today!"
GOAL_ADVICE = {
    "Weight_Loss": "Stay hydrated and focus on whole foods for sustainable weight loss.",
    "Weight_Gain": "Don't forget to include healthy fats and complex carbs for quality weight gain.",
    "Muscle_Gain": "Your protein intake is key for muscle development - keep it consistent!",
    "Maintenance": "Maintaining a balanced approach to nutrition - you're doing great!",
}
FEEDBACK_FALLBACK = "Keep up the great work with your nutrition tracking!"
# Default goals when a member has none.
DEFAULT_GOALS = {"daily_calorie_goal": 2000.0, "daily_protein_goal": 150.0,
                 "daily_carbs_goal": 250.0, "daily_fat_goal": 70.0, "goal_type": "Maintenance"}


def nutrition_feedback(calories, protein, calorie_goal, protein_goal, goal_type) -> Column:
    """sentences joined by a space, chosen by calorie and protein progress and goal."""
    cal_pct = F.try_divide(_d(calories), _d(calorie_goal)) * 100.0
    pro_pct = F.try_divide(_d(protein), _d(protein_goal)) * 100.0
    cal_part = (F.when(cal_pct < 30, F.lit(FEEDBACK_CALORIES[0]))
                .when(cal_pct < 70, F.lit(FEEDBACK_CALORIES[1]))
                .when(cal_pct < 100, F.lit(FEEDBACK_CALORIES[2]))
                .otherwise(F.lit(FEEDBACK_CALORIES[3])))
    pro_part = (F.when(pro_pct < 50, F.lit(FEEDBACK_PROTEIN_LOW))
                .when(pro_pct > 80, F.lit(FEEDBACK_PROTEIN_HIGH)))
    advice = F.try_element_at(F.create_map(*[x for k, v in GOAL_ADVICE.items()
                                         for x in (F.lit(k), F.lit(v))]), _c(goal_type))
    text = F.concat_ws(" ", cal_part, pro_part, advice)
    # a zero goal is a division error in the reference, which falls back to one sentence
    return F.when(cal_pct.isNull() | pro_pct.isNull(), F.lit(FEEDBACK_FALLBACK)).otherwise(text)


# Recommendation sentences and thresholds.
RECOMMENDATIONS = {
    "low_cal": "This appears to be a low-calorie food. Consider adding protein or healthy fats for better satiety.",
    "high_cal": "This is a high-calorie food. Consider portion control or balancing with lower-calorie options.",
    "low_protein": "Low in protein. Consider adding lean protein sources to your meal.",
    "high_protein": "Good protein content! This will help with muscle maintenance and satiety.",
    "high_carbs": "High in carbohydrates. Consider pairing with protein and fiber for better blood sugar control.",
    "high_fat": "High in fat. Consider portion control or choosing lower-fat alternatives.",
    "default": "Keep tracking your meals for personalized nutrition insights!",
}


def food_recommendations(calories, protein, carbs, fat) -> Column:
    """ordered list of recommendation sentences; a default sentence when none applies."""
    cal, p, c, f = (F.coalesce(_d(x), F.lit(0.0)) for x in (calories, protein, carbs, fat))
    items = F.array_compact(F.array(
        F.when((cal > 0) & (cal < 100), F.lit(RECOMMENDATIONS["low_cal"]))
         .when(cal > 500, F.lit(RECOMMENDATIONS["high_cal"])),
        F.when((p > 0) & (p < 5), F.lit(RECOMMENDATIONS["low_protein"]))
         .when(p > 20, F.lit(RECOMMENDATIONS["high_protein"])),
        F.when(c > 50, F.lit(RECOMMENDATIONS["high_carbs"])),
        F.when(f > 15, F.lit(RECOMMENDATIONS["high_fat"])),
    ))
    return F.when(F.size(items) == 0, F.array(F.lit(RECOMMENDATIONS["default"]))).otherwise(items)


# Mifflin-St Jeor activity multipliers, goal adjustments, macro splits.
ACTIVITY_MULTIPLIERS = {"sedentary": 1.2, "lightly_active": 1.375, "moderately_active": 1.55,
                        "very_active": 1.725, "extremely_active": 1.9}
GOAL_ADJUSTMENTS = {"weight_loss": 0.85, "muscle_gain": 1.1, "maintenance": 1.0}
MACRO_RATIOS = {
    "weight_loss": (0.3, 0.4, 0.3),
    "muscle_gain": (0.35, 0.45, 0.2),
    "maintenance": (0.25, 0.5, 0.25),
}


def _lookup(mapping: dict, key: Column, default: float) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.lower(key)), F.lit(default))


def nutritional_needs(age, gender, weight, height, activity_level, goal) -> Column:
    """struct of daily calories/protein/carbs/fat, BMR and TDEE (rounded half-even)."""
    base = 10.0 * _d(weight) + 6.25 * _d(height) - 5.0 * _d(age)
    bmr = F.when(F.lower(_c(gender)) == "male", base + 5.0).otherwise(base - 161.0)
    tdee = bmr * _lookup(ACTIVITY_MULTIPLIERS, _c(activity_level), 1.2)
    cal = tdee * _lookup(GOAL_ADJUSTMENTS, _c(goal), 1.0)
    g = F.lower(_c(goal))
    ratios = {i: F.coalesce(*[F.when(g == k, F.lit(v[i])) for k, v in MACRO_RATIOS.items()],
                            F.lit(MACRO_RATIOS["maintenance"][i])) for i in range(3)}
    r = lambda x: F.bround(x, 0).cast("long")
    return F.struct(r(cal).alias("daily_calories"), r(cal * ratios[0] / 4.0).alias("daily_protein"),
                    r(cal * ratios[1] / 4.0).alias("daily_carbs"),
                    r(cal * ratios[2] / 9.0).alias("daily_fat"),
                    r(bmr).alias("bmr"), r(tdee).alias("tdee"))


def meal_macros(calorie_target) -> Column:
    """30/45/25 % split of a calorie target, truncated to whole grams."""
    cal = _d(calorie_target)
    return F.struct((cal * 0.3 / 4).cast("int").alias("protein"),
                    (cal * 0.45 / 4).cast("int").alias("carbs"),
                    (cal * 0.25 / 9).cast("int").alias("fat"))


def calories_from_macros(calories, protein, carbs, fat) -> Column:
    """energy from 4/4/9 kcal per gram when the stated calories are 0."""
    derived = 4 * _d(protein) + 4 * _d(carbs) + 9 * _d(fat)
    return F.when(F.coalesce(_d(calories), F.lit(0.0)) == 0, derived).otherwise(_d(calories))
