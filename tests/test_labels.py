"""A label in ``survey_ids`` means that the query's plan is built by that operator."""

import sys

import pytest

from gymlake.functions import nutrition_fx, text, timeutil, variant_docs
from gymlake.operators import (attendance, billing, bookings, filters, foods, meal_plans, messages, nutrition,
                               ordering, scheduling, upserts, substrings)
from gymlake.plans import catalog, reports
from gymlake.sources import contracts, json_docs, keyed, sinks
from gymlake.sources.tables import Tables
from gymlake.streaming import streams

catalog.queries()
OPERATORS = {
    "S2": [contracts.describe_table], "S3": [contracts.check_constraints], "S5": [json_docs.read_food_json, variant_docs.read_drifted_lines],
    "S6": [sinks.write_report], "S7": [sinks.append],
    "P2": [filters.for_entity], "P9": [filters.with_ids], "P12": [filters.on_day], "P16": [filters.to_nested_session],
    "P17": [filters.entitled], "P18": [filters.upcoming],
    "J2": [attendance.member_session_history], "J12": [bookings.reject_duplicates, upserts.validate_members],
    "J20": [foods.estimate_nutrition, substrings.first_hits], "J22": [meal_plans.coach_plans], "J23": [attendance.coach_profile],
    "A24": [scheduling.availability_map, scheduling.sessions_by_slot, scheduling.month_calendar, meal_plans.plans_by_member,
            scheduling.available_members],
    "A26": [nutrition.accumulate_day, streams.run_daily_nutrition], "A27": [billing.gym_capacity], "A28": [scheduling.group_availability],
    "O1": [ordering.order_sessions], "O4": [ordering.paginate, ordering.deep_page], "O5": [ordering.suggest, substrings.suggest_terms],
    "F9": [timeutil.fmt_date, timeutil.fmt_time], "F26": [nutrition_fx.num_or_zero], "F8": [text.cap_first],
    "X7": [bookings.validate_bookings, streams.run_bookings], "X8": [billing.session_payments], "X9": [billing.renewal_payments],
    "X10": [upserts.upsert, streams.run_availability], "X11": [scheduling.bulk_requests_to_slots], "X12": [upserts.select_plans],
    "X13": [upserts.cascade_delete, upserts.guarded_delete, keyed.KeyedTable.delete], "X14": [foods.flatten_food_nutrients], "X15": [foods.best_food_match],
    "X16": [foods.flatten_products], "X17": [nutrition.detected_food_rows, nutrition.log_detected_foods],
    "X18": [nutrition.log_foods], "X19": [upserts.update_rows, upserts.meal_corrections],
    "X20": [meal_plans.explode_plan, meal_plans.shopping_list], "X22": [messages.validate_messages],
    "X23": [upserts.validate_members, upserts.validate_coaches], "X24": [upserts.reassign_coach],
    "X30": [meal_plans.validate_feedback, meal_plans.create_plans], "X31": [meal_plans.plan_list],
    "X33": [reports.coach_schedule, reports.member_schedule], "X40": [scheduling.availability_map],
    "X42": [foods.resolve_nutrition], "T1": [streams.run_daily_nutrition], "T2": [streams.run_availability], "T3": [streams.run_bookings],
}
LABELLED = sorted(n for n, e in catalog.REGISTRY.items() if set(e.survey_ids.split()) & set(OPERATORS))


def called_while_building(spark, entry):
    seen = set()

    def watch(frame, event, _arg):
        if event == "call":
            seen.add(frame.f_code)
    tables = Tables(spark, "/root/testdata/sf0.001")
    sys.setprofile(watch)
    try:
        entry.build(tables)
    finally:
        sys.setprofile(None)
    return seen


@pytest.mark.parametrize("name", LABELLED)
def test_labelled_operators_are_reached(spark, name):
    entry = catalog.REGISTRY[name]
    seen = called_while_building(spark, entry)
    missed = [i for i in entry.survey_ids.split()
              if i in OPERATORS and not any(f.__code__ in seen for f in OPERATORS[i])]
    assert not missed


def test_every_listed_operator_has_a_query():
    labels = {i for e in catalog.REGISTRY.values() for i in e.survey_ids.split()}
    assert set(OPERATORS) <= labels
