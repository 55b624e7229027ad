"""Column functions on literal rows: the boundary cases of SURVEY §1.4-1.5."""

from pyspark.sql import functions as F

from gymlake.functions import nutrition_fx as nfx
from gymlake.functions.notes import format_notes, parse_notes_lenient, parse_notes_sql, parse_notes_strict
from gymlake.functions.rates import performance_rating, rate
from gymlake.functions.text import cap_first, split_name, valid_email, valid_message
from gymlake.functions.timeutil import hours_to_block, next_occurrence, to_hour, weekday_from_name


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_notes_strict(spark):
    notes = "Workout Type:  Push \n1. Bench\n\tnot numbered\n 2. Dips \n"
    r = one(spark, parse_notes_strict("v"), notes)
    assert r["workout_type"] == "Push"
    assert r["exercises"] == ["1. Bench", "2. Dips"]
    assert one(spark, parse_notes_strict("v"), None)["workout_type"] == "Custom"
    assert one(spark, parse_notes_strict("v"), "")["exercises"] == []
    # marker twice on a line: the text between the first and second marker
    assert one(spark, parse_notes_strict("v"), "Workout Type: A Workout Type: B")["workout_type"] == "A"


def test_notes_lenient_and_sql(spark):
    r = one(spark, parse_notes_lenient("v"), "Push Workout:\nBench Press\n\n  Row  ")
    assert r["workout_type"] == "Push" and r["exercises"] == ["Bench Press", "Row"]
    s = one(spark, parse_notes_sql("v"), "x Workout Type: A\nWorkout Type: B\nExercises: squat, lunge")
    assert s["workout_type"] == "B" and s["exercises"] == ["squat", "lunge"]
    assert one(spark, parse_notes_sql("v"), "nothing")["workout_type"] == "General Training"


def test_format_notes(spark):
    df = spark.createDataFrame([("Core", ["Plank", "Crunch"], "hydrate")], "t string, e array<string>, n string")
    assert df.select(format_notes("t", "e", "n")).first()[0] == \
        "Workout Type: Core\nExercises:\n1. Plank\n2. Crunch\n\nhydrate"


def test_rounding_modes(spark):
    df = spark.createDataFrame([(6225, 10000)], "a int, b int")
    assert df.select(rate("a", "b", 1, "half_even")).first()[0] == 62.2
    assert df.select(rate("a", "b", 1, "half_up")).first()[0] == 62.3
    z = spark.createDataFrame([(1, 0)], "a int, b int")
    assert z.select(rate("a", "b", 1)).first()[0] is None
    assert one(spark, performance_rating(F.lit(None).cast("double")), 0, "v int") == 85.0
    assert one(spark, performance_rating(F.lit(95.0)), 0, "v int") == 100.0
    assert one(spark, performance_rating(F.lit(10.0)), 0, "v int") == 60.0


def test_text_helpers(spark):
    assert one(spark, valid_email("v"), "a@b.c") is True
    assert one(spark, valid_email("v"), "ab.c") is False
    assert one(spark, valid_message("v"), "   ") is False
    assert one(spark, valid_message("v"), "x" * 1001) is False
    assert one(spark, cap_first("v"), "completed") == "Completed"
    r = one(spark, split_name("v"), "Ada")
    assert (r["first_name"], r["last_name"]) == ("Ada", "")


def test_time_helpers(spark):
    assert one(spark, to_hour("v"), "00:30") == 0          # D13: hour 0 is a value
    assert one(spark, to_hour("v"), "bad") is None
    assert one(spark, weekday_from_name("v"), "Sunday") == 6
    assert one(spark, hours_to_block("v"), 0, "v int") == 1
    assert one(spark, hours_to_block("v"), 61, "v int") == 2
    df = spark.createDataFrame([(3, 10)], "d int, h int")  # Thursday 10:00
    now = F.to_timestamp_ntz(F.lit("2024-01-25 10:00:00"))  # a Thursday, exactly 10:00
    got = df.select(next_occurrence(F.col("d"), F.col("h"), now).cast("string")).first()[0]
    assert got == "2024-02-01 10:00:00"  # not strictly after now -> next week


def test_health_score_and_feedback(spark):
    df = spark.createDataFrame([(0.0, 10.0, 10.0, 10.0), (1350.0, 129.0, 127.0, 32.0),
                                (500.0, 0.0, 0.0, 0.0)], "c double, p double, cb double, f double")
    scores = [r[0] for r in df.select(nfx.health_score("c", "p", "cb", "f")).collect()]
    assert scores[0] == 5.0 and scores[2] == 5.0
    assert 0 <= scores[1] <= 10
    fb = spark.createDataFrame([(100.0, 10.0, 0.0, 150.0)], "c double, p double, g double, pg double")
    assert fb.select(nfx.nutrition_feedback("c", "p", "g", "pg", F.lit("Weight_Loss"))).first()[0] == \
        nfx.FEEDBACK_FALLBACK


def test_recommendations_default(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "c double, p double, cb double, f double")
    assert df.select(nfx.food_recommendations("c", "p", "cb", "f")).first()[0] == \
        [nfx.RECOMMENDATIONS["default"]]
