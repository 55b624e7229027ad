"""Registered queries: nutrition reports over order lines stored in buckets of the order id."""

from __future__ import annotations

from gymlake.operators import nutrition as nu
from gymlake.plans.catalog import REGISTRY, register
from gymlake.plans import q_nutrition  # noqa: F401  (its entries give the SQL)
from gymlake.sources.bucketed import BucketedTables, store_raw

# What the nutrition logs read of the two tables.
LOG_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
}


def stored_logs(t) -> BucketedTables:
    return BucketedTables(t.spark, t.root, store_raw(t, LOG_COLUMNS))


@register("bucketed_daily_nutrition", REGISTRY["daily_nutrition"].oracle, ["nutrition_logs"], "A20 S1")
def _bucketed_daily_nutrition(t):
    return nu.daily_nutrition(stored_logs(t).nutrition_logs)


@register("bucketed_nutrition_analytics", REGISTRY["nutrition_analytics_all"].oracle,
          ["member_coach", "members", "nutrition_logs"], "A18 S1 J5")
def _bucketed_nutrition_analytics(t):
    return nu.nutrition_analytics(t.members, t.member_coach, stored_logs(t).nutrition_logs, "all", q_nutrition.AS_OF)
