"""Physical-plan guards for every registered batch query.

No query may pair rows (Cartesian product, nested-loop join), run Python per row,
or pull rows into one task: a single-partition exchange is only allowed above a
partial aggregate (one row per map task).  Per-key top-N must be cut before the
shuffle (WindowGroupLimit) and scans must be pruned.
"""

import contextlib
import io
import itertools
import re

import pytest

from gymlake.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CollectLimit")
# Queries whose limit is the feature (five search suggestions).
GLOBAL_TOP_K = {"member_suggestions"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_plan_is_scale_safe(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    assert not [p for p in FORBIDDEN if p in plan], plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            # a partial aggregate (possibly constant-folded to no functions) sends one
            # row per map task
            partial = "partial_" in below or "HashAggregate(keys=[], functions=[])" in below
            assert partial, f"rows gathered into one task:\n{plan}"
    if "TakeOrderedAndProject" in plan:
        assert name in GLOBAL_TOP_K, plan


# match_slots picks inside the pair's row and shuffles no candidate at all
# (test_stored_masks_intervals.py::test_slot_matching_shuffles_no_candidates)
@pytest.mark.parametrize("name", ["latest_sessions", "member_session_page",
                                  "gym_recent_sessions"])
def test_top_n_per_key_is_cut_before_the_shuffle(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    partial = [ln for ln in plan.splitlines() if "WindowGroupLimit" in ln and "Partial" in ln]
    assert partial, plan


@pytest.mark.parametrize("name", ["gym_recent_sessions", "export_dashboard_gym", "export_dashboard_coach",
                                  "export_dashboard_member", "member_session_page", "member_recent_sessions"])
def test_the_cut_is_below_the_dimension_joins(spark, name):
    df = QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [(re.search(r"\w", ln).start(), ln) for ln in text.splitlines() if re.match(r"^[ :]*(\+-|:-) ", ln)]
    cut = next(i for i, (_, ln) in enumerate(nodes) if "WindowGroupLimit" in ln)
    assert any("Join " in ln for _, ln in nodes[:cut]), text
    below = list(itertools.takewhile(lambda n: n[0] > nodes[cut][0], nodes[cut + 1:]))
    # only the session source's own join (events with suppliers)
    assert sum("Join " in ln for _, ln in below) <= 1, text


def test_the_gym_report_scans_sessions_once(spark):
    plan = plan_text(QUERIES["gym_session_report"](spark, SF))
    assert len([ln for ln in plan.splitlines() if "FileScan parquet" in ln and "events" in ln]) == 1, plan


def test_fact_scan_is_pruned_and_filtered(spark):
    plan = plan_text(QUERIES["recent_month_sessions"](spark, SF))
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "events" in ln]
    assert scans and all("PushedFilters: [" in ln for ln in scans)
    assert all("ReadSchema: struct<" in ln for ln in scans)
