"""Booking validation against tenancy, assignment and conflicts.

Every check is a semi/anti join or a grouped aggregate on the conflict key.
Requests of one batch are accepted as if they came one after the other: a
request only blocks later ones if it is itself accepted.  That order is
resolved in passes over the open requests, each a partial aggregate
(``min(request_id)`` per cell, skew-safe) joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.notes import format_notes
from gymlake.session import cut_lineage

COACH_CELL = ["coach_id", "session_date", "session_time"]
MEMBER_CELL = ["member_id", "session_date", "session_time"]
REQUIRED = ("member_id", "coach_id", "session_date", "session_time", "duration")
# Rejection reasons, in the order the checks run.
REASONS = {
    "missing": "Missing required field",
    "tenancy": "Invalid member or coach ID",
    "assignment": "Member is not assigned to this coach",
    "coach_conflict": "Coach already has a session at this time",
    "member_conflict": "Member already has a session at this time",
    "repeated": "Request id already used by another request",
    "batch_conflict": "Conflicts with an earlier request in this batch",
}


def slot_conflicts(sessions: DataFrame, who: str = "coach_id") -> DataFrame:
    """(person, date, time) cells held by more than one non-cancelled session."""
    active = sessions.filter(F.lower("status") != "cancelled")
    return (active.groupBy(who, "session_date", "session_time")
            .agg(F.count(F.lit(1)).alias("sessions"))
            .filter(F.col("sessions") > 1))


def reject_duplicates(new: DataFrame, existing: DataFrame, key, order_col: str) -> DataFrame:
    """Rows of ``new`` whose key is not taken yet, first per key within the batch."""
    key = [key] if isinstance(key, str) else list(key)
    fresh = new.join(existing.select(*key).distinct(), key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min(order_col).alias("_first"))
    return (fresh.join(first, key).filter(F.col(order_col) == F.col("_first")).drop("_first"))


def accept_in_order(candidates: DataFrame) -> DataFrame:
    """Ids of the requests that sequential booking by ``request_id`` accepts.

    A pass accepts every open request that is first in its coach cell and in its
    member cell, and closes the others in those cells.  The earliest open request
    is always first in both, so passes go on until none is open; their number is
    the length of the longest chain of conflicts, not of the batch.
    """
    def marked(open_: DataFrame) -> DataFrame:
        """The open requests, ``_won`` where a request is first in both of its cells."""
        first_c = open_.groupBy(*COACH_CELL).agg(F.min("request_id").alias("_c"))
        first_m = open_.groupBy(*MEMBER_CELL).agg(F.min("request_id").alias("_m"))
        rows = (open_.join(first_c, COACH_CELL).join(first_m, MEMBER_CELL)
                .select("request_id", *COACH_CELL, "member_id",
                        ((F.col("request_id") == F.col("_c")) & (F.col("request_id") == F.col("_m"))).alias("_won")))
        return cut_lineage(rows)

    state = marked(candidates.select("request_id", *COACH_CELL, "member_id"))
    accepted = state.filter("_won").select("request_id")
    while not state.isEmpty():
        now = state.filter("_won")
        # what an accepted request shares a cell with is closed
        state = marked(state.filter("NOT _won").drop("_won")
                       .join(now.select(*COACH_CELL), COACH_CELL, "left_anti")
                       .join(now.select(*MEMBER_CELL), MEMBER_CELL, "left_anti"))
        accepted = accepted.unionByName(state.filter("_won").select("request_id"))
    return accepted


REQUEST = ["coach_id", "member_id", "session_date", "session_time", "duration"]


def one_per_request(requests: DataFrame) -> DataFrame:
    """Requests that were sent twice count once.  Of different requests under one id the first
    (in the order of their columns) has it; the others are ``_repeated``."""
    # rows without an id are not one group
    group = F.coalesce(F.col("request_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(*REQUEST).cast("string")))
    same = Window.partitionBy("_group").orderBy(*REQUEST)
    return (requests.withColumn("_group", group)
            .withColumn("_rank", F.rank().over(same)).withColumn("_row", F.row_number().over(same))
            .filter("_rank = _row").withColumn("_repeated", (F.col("_rank") > 1) & F.col("request_id").isNotNull())
            .drop("_group", "_rank", "_row"))


def session_rows(bookings: DataFrame, coaches: DataFrame) -> DataFrame:
    """The session rows of bookings (accepted ones, or any where no conflict is checked):
    the coach's gym, status ``Scheduled``, and notes from workout type, exercises and free text
    (F4).  A coach without a gym gets no session."""
    gym = coaches.select(F.col("id").alias("coach_id"), "gym_id").filter("gym_id IS NOT NULL")
    return (bookings.join(gym, "coach_id")
            .select("request_id", "gym_id", "coach_id", "member_id", "session_date", "session_time", "duration",
                    F.lit("Scheduled").alias("status"), format_notes("workout_type", "exercises", "notes").alias("notes")))


def validate_bookings(requests: DataFrame, members: DataFrame, coaches: DataFrame,
                      member_coach: DataFrame, sessions: DataFrame,
                      check_assignment: bool = True) -> DataFrame:
    """Every request with ``accepted`` and the first failing ``reason``.  A request that was
    sent again as it was is one request.

    Checks, in order: an id that another request has; required fields; member and coach in one gym (J13);
    assignment (J9); exact (coach, date, time) and (member, date, time) clash
    with a non-cancelled session (J11); clash with an earlier accepted request of
    the same batch (requests are booked one after the other, by request id).
    """
    missing = F.col("request_id").isNull()
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    active = sessions.filter(F.lower("status") != "cancelled")
    coach_busy = active.select(*COACH_CELL).distinct().withColumn("_coach_busy", F.lit(True))
    member_busy = active.select(*MEMBER_CELL).distinct().withColumn("_member_busy", F.lit(True))
    # J13 as two lookups on the request row (no second pass over the batch)
    member_gym = members.select(F.col("id").alias("member_id"), F.col("gym_id").alias("_mg"))
    coach_gym = coaches.select(F.col("id").alias("coach_id"), F.col("gym_id").alias("_cg"))
    assigned = (member_coach.select("member_id", "coach_id").distinct()
                .withColumn("_assigned", F.lit(True)))
    r = (one_per_request(requests).withColumn("_missing", missing)
         .join(member_gym, "member_id", "left").join(coach_gym, "coach_id", "left")
         .withColumn("_same_gym", F.when(F.col("_mg") == F.col("_cg"), F.lit(True)))
         .join(assigned, ["member_id", "coach_id"], "left")
         .join(coach_busy, COACH_CELL, "left")
         .join(member_busy, MEMBER_CELL, "left"))
    pre = (F.when(F.col("_repeated"), F.lit(REASONS["repeated"]))
           .when(F.col("_missing"), F.lit(REASONS["missing"]))
           .when(F.col("_same_gym").isNull(), F.lit(REASONS["tenancy"])))
    if check_assignment:
        pre = pre.when(F.col("_assigned").isNull(), F.lit(REASONS["assignment"]))
    pre = (pre.when(F.col("_coach_busy").isNotNull(), F.lit(REASONS["coach_conflict"]))
           .when(F.col("_member_busy").isNotNull(), F.lit(REASONS["member_conflict"])))
    # one pass over the requests; what follows reads only these columns of it
    checked = cut_lineage(r.select("request_id", "coach_id", "member_id", "session_date", "session_time",
                                   "duration", pre.alias("_pre")))
    won = accept_in_order(checked.filter(F.col("_pre").isNull())).withColumn("_won", F.lit(True))
    reason = F.coalesce("_pre", F.when(F.col("_won").isNull(), F.lit(REASONS["batch_conflict"])))
    # of rows that share an id, only the one that was open can have won
    return (checked.join(won.withColumnRenamed("request_id", "_id"),
                         (F.col("request_id") == F.col("_id")) & F.col("_pre").isNull(), "left")
            .select("request_id", "coach_id", "member_id", "session_date", "session_time", "duration",
                    reason.isNull().alias("accepted"), reason.alias("reason")))
