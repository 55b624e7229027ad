"""Prices per tier for sessions and renewals, capacity.

Price tables are literal (three tiers), so broadcasting them is safe by
construction; every other join here is left to AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.functions.rates import capacity
from gymlake.operators.attendance import BILLING_PRICES, tier_price

# Per-session price by membership tier.
SESSION_PRICES = {"Basic": 25.0, "Premium": 20.0, "VIP": 15.0}
DEFAULT_SESSION_PRICE = 25.0


def session_payments(bookings: DataFrame, members: DataFrame, prices: dict | None = None) -> DataFrame:
    """One pending ``Session`` payment per accepted booking, priced by tier (D16:
    the payment carries its session/request id)."""
    prices = prices or SESSION_PRICES
    m = members.select(F.col("id").alias("member_id"), "gym_id", "membership_type")
    return (bookings.join(m, "member_id")
            .withColumn("price", tier_price("membership_type", prices))
            .select("request_id", "member_id", "gym_id",
                    F.coalesce("price", F.lit(DEFAULT_SESSION_PRICE)).alias("amount"),
                    F.lit("Session").alias("payment_type"), F.lit("Pending").alias("status"),
                    F.concat(F.lit("Payment for session on "),
                             F.date_format("session_date", "yyyy-MM-dd"), F.lit(" at "),
                             F.col("session_time")).alias("notes")))


def renewal_payments(members: DataFrame, prices: dict | None = None) -> DataFrame:
    """Monthly renewal per member at the billing price; unknown tiers rejected."""
    prices = prices or BILLING_PRICES
    j = members.select(F.col("id").alias("member_id"), "gym_id", "membership_type") \
        .withColumn("price", tier_price("membership_type", prices))
    return j.select("member_id", "gym_id", "membership_type",
                    F.col("price").alias("amount"),
                    F.lit("Membership").alias("payment_type"),
                    F.when(F.col("price").isNull(), F.lit("Rejected")).otherwise(F.lit("Pending"))
                    .alias("status"),
                    F.concat(F.lit("Monthly membership renewal - "), F.col("membership_type"))
                    .alias("notes"))


def gym_capacity(members: DataFrame, ideal: int = 100) -> DataFrame:
    """Member head count against an ideal capacity, capped at 100 %."""
    return (members.groupBy("gym_id").agg(F.count(F.lit(1)).alias("members"))
            .withColumn("capacity_pct", F.round(capacity("members", ideal), 2)))
