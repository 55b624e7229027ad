"""Registered queries: the streaming jobs T1-T3, run to completion over the
available input (``availableNow``) and read back from their sink tables."""

from __future__ import annotations

import uuid

from gymlake.plans.catalog import register
from gymlake.plans.q_scheduling import _VALIDATE
from gymlake.sources.tables import Tables
from gymlake.streaming import streams as st


def _fresh(t: Tables) -> str:
    """Input text of a run of its own: a registered query answers from its input and not from
    what an earlier run stored."""
    return f"{t.root}#{uuid.uuid4().hex}"


def _streamed(t: Tables, *raw) -> Tables:
    # no limit per trigger: what is there when the job starts is one micro-batch, so
    # the bookings of T3 come in request order as in the batch form
    return Tables(t.spark, t.root, streamed=raw, max_files_per_trigger=None)


@register("stream_daily_nutrition", """
SELECT member_id, log_date, CAST(SUM(total_calories) AS DECIMAL(18,2)) AS calories,
       CAST(SUM(total_protein) AS DECIMAL(18,2)) AS protein, CAST(SUM(total_carbs) AS DECIMAL(18,2)) AS carbs,
       CAST(SUM(total_fat) AS DECIMAL(18,2)) AS fat, COUNT(*) AS entries_count
FROM nutrition_logs GROUP BY member_id, log_date
""", ["nutrition_logs"], "T1 A20 A26")
def _stream_daily_nutrition(t):
    s = _streamed(t, "lineitem")
    return st.run_daily_nutrition(s.nutrition_logs, _fresh(t))


@register("stream_availability", """
SELECT user_id, user_type, slot_date, hour, is_available, seq FROM availability_slots
""", ["availability_slots"], "T2 X10 W5")
def _stream_availability(t):
    s = _streamed(t, "events")
    return st.run_availability(s.slot_updates, _fresh(t))


@register("stream_bookings", "WITH RECURSIVE " + _VALIDATE.replace("booking_requests", "order_booking_requests") + """
SELECT *, reason IS NULL AS accepted FROM v
""", ["order_booking_requests", "members", "coaches", "member_coach", "sessions"], "T3 X7")
def _stream_bookings(t):
    s = _streamed(t, "orders")
    return st.run_bookings(s.order_booking_requests, t.members, t.coaches, t.member_coach, t.sessions, _fresh(t))
