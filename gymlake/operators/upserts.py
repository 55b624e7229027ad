"""Keyed upserts, deletes and import checks.

Upserts are "union, then keep the last write per key": a grouped ``max_by``
over the sequence, for updates and for base rows -- a partial aggregate, so one
hot key is combined on every map task before the shuffle; by one number it is a
hash aggregate.  Deletes are anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.functions.text import normalise_enum, valid_email
from gymlake.operators.bookings import reject_duplicates

MEMBERSHIP_TYPES = ("Basic", "Premium", "VIP")
# Import rejection reasons, in check order.
IMPORT_REASONS = {
    "missing": "Missing required field",
    "email": "Invalid email format",
    "tier": "Invalid membership type",
    "duplicate": "Email already registered",
    "batch": "Email repeated in this import",
    "coach": "Invalid or inactive coach ID",
}


def upsert(base: DataFrame, updates: DataFrame, key, order_cols, keep_first=("created_at",)) -> DataFrame:
    """Last write wins per ``key``; ``order_cols`` rank writes (base rows get
    priority 0, updates priority 1, then the given order).  Columns named in
    ``keep_first`` keep their earliest value (the reference never rewrites
    ``created_at``)."""
    key = [key] if isinstance(key, str) else list(key)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    cols = [c for c in base.columns]
    both = (base.select(*cols).withColumn("_prio", F.lit(0))
            .unionByName(updates.select(*cols).withColumn("_prio", F.lit(1))))
    # the partial aggregate sorts its task's rows (text has no place in a hash aggregate's buffer), and a
    # scan may be one task: writes are dealt by key and order first, so those of a hot key stay apart
    both = both.repartition(*key, *order_cols)
    payload = [c for c in cols if c not in key]
    types = dict(both.dtypes)
    if len(order_cols) == 1 and types[order_cols[0]] in ("tinyint", "smallint", "int", "bigint"):
        # one number ranks the writes: the last update, else the last base row; a missing number is the smallest
        seq = F.coalesce(F.col(order_cols[0]).cast("long"), F.lit(-2**63))
        last = {p: F.when(F.col("_prio") == p, seq) for p in (0, 1)}
        aggs = [F.max("_prio").alias("_touched")]
        for c in payload:
            if c in keep_first:
                aggs.append(F.min(c).alias(c))
            else:
                aggs += [F.max_by(c, last[p]).alias(f"_{p}_{c}") for p in (0, 1)]
        done = both.groupBy(*key).agg(*aggs)
        return done.select(*[F.col(c) if c in key or c in keep_first
                             else F.when(F.col("_touched") == 1, F.col(f"_1_{c}")).otherwise(F.col(f"_0_{c}")).alias(c) for c in cols])
    rank = F.struct(F.col("_prio"), *[F.col(c) for c in order_cols])
    aggs = [F.max_by(F.col(c), rank).alias(c) for c in payload if c not in keep_first]
    aggs += [F.min(F.col(c)).alias(c) for c in payload if c in keep_first]
    return both.groupBy(*key).agg(*aggs).select(*cols)


def cascade_delete(ids: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Remove rows referencing deleted ids from each child table (anti join per table)."""
    key = ids.columns[0]
    gone = ids.select(key).distinct()
    return {name: df.join(gone.withColumnRenamed(key, fk), fk, "left_anti")
            for name, (df, fk) in children.items()}


def update_rows(base: DataFrame, patches: DataFrame, key, allowed: dict | None = None,
                order_col: str | None = None) -> DataFrame:
    """Patch columns of matching rows; NULL in a patch keeps the old value;
    values outside ``allowed[col]`` are ignored.  Several patches of one key apply in
    the order of ``order_col``: each column gets its last value that is not NULL."""
    key = [key] if isinstance(key, str) else list(key)
    p = patches
    for col, values in (allowed or {}).items():
        p = p.withColumn(col, F.when(F.col(col).isin(*values), F.col(col)))
    pcols = [c for c in p.columns if c not in key and c != order_col]

    def last(c):
        if order_col is None:  # without an order the largest value, so the result is one row and stable
            return F.max(c)
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col)))

    p = p.groupBy(*key).agg(*[last(c).alias(f"_new_{c}") for c in pcols])
    j = base.join(p, key, "left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in pcols else F.col(c)
                      for c in base.columns])


def guarded_delete(rows: DataFrame, requests: DataFrame, key, owner) -> DataFrame:
    """Rows left after delete requests; a request counts only where it names the
    row's owner (one column or several, such as a sender's id and type)."""
    key = [key] if isinstance(key, str) else list(key)
    owner = [owner] if isinstance(owner, str) else list(owner)
    return rows.join(requests.select(*key, *owner).distinct(), [*key, *owner], "left_anti")


def meal_corrections(logs: DataFrame, patches: DataFrame, units) -> DataFrame:
    """Corrected meals: a patch replaces the stated values of the member's own entry;
    one with a missing field or an unknown unit is ignored, and the last by ``seq`` wins."""
    fields = ["custom_food_name", "meal_type", "quantity", "unit", "total_calories", "total_protein",
              "total_carbs", "total_fat"]
    whole = F.col("unit").isin(*units)
    for c in fields:
        whole = whole & F.col(c).isNotNull()
    last = (patches.filter(whole).groupBy("id", "member_id")
            .agg(F.max_by(F.struct(*fields), "seq").alias("_new")))
    return (logs.join(last, ["id", "member_id"], "left")
            .select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in logs.columns]))


COACH_REASONS = {"missing": "Missing required field", "email": "Invalid email format",
                 "duplicate": "Email already registered", "batch": "Email repeated in this import"}


def validate_coaches(imports: DataFrame, coaches: DataFrame) -> DataFrame:
    """Required fields, email shape (F5), email free in the table and first in the
    import (J12).  Every row is returned with ``accepted`` and ``reason``."""
    # emails are one whatever their case
    known = coaches.select(F.lower("email").alias("_email"))
    taken = known.distinct().withColumn("_taken", F.lit(True))
    r = imports.withColumn("_email", F.lower("email")).join(taken, "_email", "left").withColumn(
        "_pre", F.when(F.col("name").isNull() | F.col("email").isNull() | F.col("specialization").isNull(),
                       F.lit(COACH_REASONS["missing"]))
        .when(~valid_email("email"), F.lit(COACH_REASONS["email"]))
        .when(F.col("_taken").isNotNull(), F.lit(COACH_REASONS["duplicate"])))
    first = reject_duplicates(r.filter(F.col("_pre").isNull()), known, "_email", "import_id") \
        .select("import_id").withColumn("_first", F.lit(True))
    reason = F.coalesce("_pre", F.when(F.col("_first").isNull(), F.lit(COACH_REASONS["batch"])))
    return (r.join(first, "import_id", "left")
            .select("import_id", "gym_id", "name", "email", "specialization", reason.isNull().alias("accepted"),
                    reason.alias("reason")))


def reassign_coach(member_coach: DataFrame, changes: DataFrame) -> DataFrame:
    """Members in ``changes`` lose every existing link; a non-null coach is linked."""
    kept = member_coach.join(changes.select("member_id").distinct(), "member_id", "left_anti")
    new = changes.filter(F.col("coach_id").isNotNull()).select(*member_coach.columns)
    return kept.unionByName(new)


def validate_members(imports: DataFrame, members: DataFrame, coaches: DataFrame) -> DataFrame:
    """Required fields, email shape (F5), tier, duplicate email against the
    table (J12) and within the import (first import id wins), coach active in the
    member's gym (J13).  Every row is returned with ``accepted`` and ``reason``."""
    tier = normalise_enum("membership_type", MEMBERSHIP_TYPES)
    existing = members.select(F.lower("email").alias("_email")).distinct() \
        .withColumn("_taken", F.lit(True))
    coach_ok = (coaches.filter(F.col("status") == "Active")
                .select(F.col("id").alias("coach_id"), "gym_id").withColumn("_coach_ok", F.lit(True)))
    r = (imports.withColumn("_email", F.lower("email"))
         .join(existing, "_email", "left")
         .join(coach_ok, ["coach_id", "gym_id"], "left"))
    pre = (F.when(F.col("name").isNull() | F.col("email").isNull()
                  | F.col("membership_type").isNull(), F.lit(IMPORT_REASONS["missing"]))
           .when(~valid_email("email"), F.lit(IMPORT_REASONS["email"]))
           .when(tier.isNull(), F.lit(IMPORT_REASONS["tier"]))
           .when(F.col("_taken").isNotNull(), F.lit(IMPORT_REASONS["duplicate"]))
           .when(F.col("coach_id").isNotNull() & F.col("_coach_ok").isNull(),
                 F.lit(IMPORT_REASONS["coach"])))
    r = r.withColumn("_pre", pre)
    first = (r.filter(F.col("_pre").isNull()).groupBy("_email")
             .agg(F.min("import_id").alias("_first")))
    r = r.join(first, "_email", "left")
    reason = F.coalesce(F.col("_pre"), F.when(F.col("_first") < F.col("import_id"),
                                               F.lit(IMPORT_REASONS["batch"])))
    return r.select("import_id", "gym_id", "name", "email", tier.alias("membership_type"),
                    "coach_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def select_plans(selections: DataFrame, plans: DataFrame, updates: DataFrame) -> DataFrame:
    """Plan-selection upsert keyed by member.  A selection must name one of the
    member's own plans (ownership semi join, J9-style); NULL selects the default.
    ``updates`` carries ``seq``; the highest ``seq`` per member wins."""
    own = plans.select(F.col("id").alias("selected_plan_id"), "member_id")
    valid = (updates.filter(F.col("selected_plan_id").isNull())
             .unionByName(updates.join(own, ["selected_plan_id", "member_id"], "left_semi")))
    new = valid.select("member_id", "selected_plan_id",
                       F.col("selected_plan_id").isNull().alias("is_default"), "seq")
    base = selections.select("member_id", "selected_plan_id", "is_default",
                             F.lit(0).cast("long").alias("seq"))
    return upsert(base, new, "member_id", ["seq"], keep_first=()).drop("seq")
