"""J19, J22, F24, X12, X20, X30, X31, A22 (plan form): nutrition plans.

The effective plan per member is selected plan -> latest plan -> default.  The
latest plan is a grouped ``max_by`` over (created_at, id) -- a partial
aggregate -- rather than a window over each member's plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.text import plan_status
from gymlake.functions.timeutil import lit_date
from gymlake.operators.foods import document

# The plan used when a member has none.
DEFAULT_PLAN = {"plan_name": "Default Plan", "daily_calories": 2000, "daily_protein": 150,
                "daily_carbs": 250, "daily_fat": 70}
PLAN_FIELDS = ("plan_name", "daily_calories", "daily_protein", "daily_carbs", "daily_fat")
PLAN_SCHEMA = ("struct<meal_plan:map<string, map<string, struct<name:string, ingredients:array<string>, "
               "nutrition:struct<calories:double, protein:double, carbs:double, fat:double>>>>, "
               "shopping_list:array<string>>")
# Feedback rejection messages.
FEEDBACK_REASONS = {"empty": "Message is required", "not_assigned": "Member is not assigned to you"}


def parse_plan(c) -> "F.Column":
    """plan JSON -> struct; malformed text -> NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, PLAN_SCHEMA)


def effective_plan(members: DataFrame, plans: DataFrame, selections: DataFrame) -> DataFrame:
    """Per member, the selected plan, else the most recent plan, else the default."""
    p = plans.select(F.col("id").alias("plan_id"), "member_id", "created_at", *PLAN_FIELDS)
    selected = (selections.filter(F.col("selected_plan_id").isNotNull())
                .select("member_id", F.col("selected_plan_id").alias("plan_id"))
                .join(p.drop("member_id"), "plan_id")
                .select("member_id", F.struct("plan_id", *PLAN_FIELDS).alias("sel")))
    latest = (p.groupBy("member_id")
              .agg(F.max_by(F.struct("plan_id", *PLAN_FIELDS), F.struct("created_at", "plan_id"))
                   .alias("lat")))
    j = (members.select(F.col("id").alias("member_id"))
         .join(selected, "member_id", "left").join(latest, "member_id", "left"))
    # the plan is chosen whole; only its missing fields take defaults
    j = j.withColumn("plan", F.coalesce("sel", "lat"))
    return j.select(
        "member_id", "plan.plan_id",
        *[F.coalesce(F.col(f"plan.{f}"), F.lit(DEFAULT_PLAN[f])).alias(f) for f in PLAN_FIELDS],
        F.when(F.col("sel").isNotNull(), F.lit("selected"))
         .when(F.col("lat").isNotNull(), F.lit("latest")).otherwise(F.lit("default")).alias("source"),
        F.col("sel").isNull().alias("is_default"))


def plan_progress(members: DataFrame, plans: DataFrame, selections: DataFrame, logs: DataFrame,
                  as_of) -> DataFrame:
    """A22 (plan form): today's totals against the effective plan; a zero target gives 0."""
    day = (logs.filter(F.col("log_date") == lit_date(as_of)).groupBy("member_id")
           .agg(*[F.sum(F.col(f"total_{m}").cast("double")).alias(m)
                  for m in ("calories", "protein", "carbs", "fat")]))
    ep = effective_plan(members, plans, selections)
    j = ep.join(day, "member_id")
    prog = lambda m: F.round(F.when(F.col(f"daily_{m}") > 0,
                                    F.col(m) / F.col(f"daily_{m}") * 100.0).otherwise(0.0), 2)
    return j.select("member_id", "plan_id", "source",
                    *[F.round(F.col(m), 2).alias(m) for m in ("calories", "protein", "carbs", "fat")],
                    *[prog(m).alias(f"{m}_progress") for m in ("calories", "protein", "carbs", "fat")])


def _explode_nonempty(col, *names) -> Column:
    """``explode`` semantics (empty or NULL collections give no row) without the
    ``size(...) > 0`` pre-filter Catalyst infers for a plain explode, which would
    parse the JSON a second time: outer explode, then drop the NULL position."""
    return F.posexplode_outer(col).alias("_pos", *names)


def explode_plan(plans: DataFrame) -> DataFrame:
    """Plan JSON -> one row per (plan, day, meal, ingredient) with the meal's macros."""
    p = plans.select(F.col("id").alias("plan_id"), "member_id", document(plans, "plan_data", PLAN_SCHEMA).alias("doc"))
    days = (p.select("plan_id", "member_id", _explode_nonempty(F.col("doc.meal_plan"), "day", "meals"))
            .filter(F.col("_pos").isNotNull()).drop("_pos"))
    meals = (days.select("plan_id", "member_id", "day", _explode_nonempty("meals", "meal", "m"))
             .filter(F.col("_pos").isNotNull()).drop("_pos"))
    return meals.select("plan_id", "member_id", "day", "meal", F.col("m.name").alias("meal_name"),
                        F.col("m.nutrition.calories").alias("calories"),
                        F.col("m.nutrition.protein").alias("protein"),
                        F.explode_outer("m.ingredients").alias("ingredient"))


def shopping_list(plans: DataFrame) -> DataFrame:
    """Distinct shopping-list items per plan."""
    p = plans.select(F.col("id").alias("plan_id"), document(plans, "plan_data", PLAN_SCHEMA).alias("doc"))
    return (p.select("plan_id", _explode_nonempty("doc.shopping_list", "item"))
            .filter(F.col("_pos").isNotNull()).select("plan_id", "item").distinct())


def plan_list(plans: DataFrame) -> DataFrame:
    """Plans per member, newest first (sorted within partitions of whole members), with
    ``active``/``inactive`` (P15)."""
    return (plans.select("member_id", F.col("id").alias("plan_id"), "plan_name", "coach_id",
                         plan_status("is_active").alias("status"),
                         F.date_format("created_at", "yyyy-MM-dd").alias("created"), "created_at")
            .repartition("member_id")
            .sortWithinPartitions("member_id", F.desc("created_at"), F.desc("plan_id")))


def plans_by_member(plans: DataFrame, members: DataFrame) -> DataFrame:
    """Each member's plans as one list, newest first (bounded by the member's plans)."""
    entry = F.struct(F.col("created_at"), F.col("id").alias("plan_id"), "plan_name",
                     plan_status("is_active").alias("status"))
    lists = plans.groupBy("member_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("plans"))
    return (lists.join(members.select(F.col("id").alias("member_id"), "name", "email"), "member_id")
            .select("member_id", "name", "email", "plans"))


def create_plans(requests: DataFrame, members: DataFrame, member_coach: DataFrame) -> DataFrame:
    """Plans that coaches create for members assigned to them (J9); others are refused."""
    pairs = (member_coach.select("coach_id", "member_id").distinct()
             .join(members.select(F.col("id").alias("member_id")), "member_id", "left_semi").withColumn("_ok", F.lit(True)))
    reason = F.when(F.col("_ok").isNull(), F.lit("Member not found"))
    return (requests.join(pairs, ["coach_id", "member_id"], "left")
            .select(*requests.columns, reason.isNull().alias("accepted"), reason.alias("reason")))


PLAN_FIELDS = ["plan_name", "daily_calories", "daily_protein", "daily_carbs", "daily_fat"]


def allowed_plan_requests(requests: DataFrame, plans: DataFrame, member_coach: DataFrame) -> DataFrame:
    """The requests (plan_id, coach_id, ...) whose coach has the plan's member."""
    access = (plans.select(F.col("id").alias("plan_id"), "member_id")
              .join(member_coach.select("member_id", "coach_id").distinct(), "member_id").select("plan_id", "coach_id"))
    return requests.join(access, ["plan_id", "coach_id"], "left_semi")


def plan_updates(requests: DataFrame, plans: DataFrame, member_coach: DataFrame) -> DataFrame:
    """Per plan the last update (by ``seq``) that states every field (an empty name or a zero
    counts as missing) and comes from a coach of the plan's member; all its fields replace the old."""
    whole = F.length("plan_name") > 0
    for c in PLAN_FIELDS[1:]:
        whole = whole & (F.col(c) != 0)
    return (allowed_plan_requests(requests.filter(whole), plans, member_coach)
            .groupBy(F.col("plan_id").alias("id"))
            .agg(*[F.max_by(c, "seq").alias(c) for c in PLAN_FIELDS]))


def coach_plans(plans: DataFrame, members: DataFrame, member_coach: DataFrame) -> DataFrame:
    """Plans of each coach's assigned members, with the member's name."""
    return (plans.join(member_coach.select("coach_id", "member_id"), ["coach_id", "member_id"])
            .join(members.select(F.col("id").alias("member_id"), F.col("name").alias("member_name")),
                  "member_id")
            .select("coach_id", "member_id", "member_name", F.col("id").alias("plan_id"), "plan_name",
                    plan_status("is_active").alias("status")))


def validate_feedback(requests: DataFrame, member_coach: DataFrame) -> DataFrame:
    """Coach feedback accepted only for assigned members and non-blank text."""
    pairs = member_coach.select("coach_id", "member_id").distinct().withColumn("_ok", F.lit(True))
    r = requests.join(pairs, ["coach_id", "member_id"], "left")
    reason = (F.when(F.coalesce(F.length(F.trim("message")), F.lit(0)) == 0, F.lit(FEEDBACK_REASONS["empty"]))
              .when(F.col("_ok").isNull(), F.lit(FEEDBACK_REASONS["not_assigned"])))
    return r.select("feedback_id", "coach_id", "member_id", "feedback_type",
                    F.coalesce("rating", F.lit(5)).alias("rating"),
                    reason.isNull().alias("accepted"), reason.alias("reason"))
