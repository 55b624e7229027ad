"""Helpers that render the fixed values of the Python operators as DuckDB SQL text
for the oracle queries (so both sides read the same constants)."""

from __future__ import annotations

from gymlake.functions import nutrition_fx as nfx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def health_score_sql(cal: str, p: str, c: str, f: str) -> str:
    cal, p, c, f = (f"CAST({x} AS DOUBLE)" for x in (cal, p, c, f))
    return (f"CASE WHEN COALESCE({p} + {c} + {f}, 0.0) = 0.0 OR {cal} IS NULL OR {cal} = 0.0 THEN 5.0 "
            f"ELSE round_even((greatest(0.0, 10.0 - abs(25.0 - {p} * 4.0 / {cal} * 100.0) / 2.5)"
            f" + greatest(0.0, 10.0 - abs(55.0 - {c} * 4.0 / {cal} * 100.0) / 5.0)"
            f" + greatest(0.0, 10.0 - abs(27.5 - {f} * 9.0 / {cal} * 100.0) / 2.75)) / 3.0, 1) END")


def feedback_sql(cal: str, pro: str, cal_goal: str, pro_goal: str, goal_type: str) -> str:
    cp = f"(CAST({cal} AS DOUBLE) / NULLIF(CAST({cal_goal} AS DOUBLE), 0.0) * 100.0)"
    pp = f"(CAST({pro} AS DOUBLE) / NULLIF(CAST({pro_goal} AS DOUBLE), 0.0) * 100.0)"
    fc = nfx.FEEDBACK_CALORIES
    cal_part = (f"CASE WHEN {cp} < 30 THEN {q(fc[0])} WHEN {cp} < 70 THEN {q(fc[1])} "
                f"WHEN {cp} < 100 THEN {q(fc[2])} ELSE {q(fc[3])} END")
    pro_part = (f"CASE WHEN {pp} < 50 THEN {q(nfx.FEEDBACK_PROTEIN_LOW)} "
                f"WHEN {pp} > 80 THEN {q(nfx.FEEDBACK_PROTEIN_HIGH)} END")
    advice = case_map(goal_type, nfx.GOAL_ADVICE)
    return (f"CASE WHEN {cp} IS NULL OR {pp} IS NULL THEN {q(nfx.FEEDBACK_FALLBACK)} "
            f"ELSE concat_ws(' ', {cal_part}, {pro_part}, {advice}) END")


def recommendations_sql(cal: str, p: str, c: str, f: str) -> str:
    r = nfx.RECOMMENDATIONS
    cal, p, c, f = (f"COALESCE(CAST({x} AS DOUBLE), 0.0)" for x in (cal, p, c, f))
    items = (f"list_filter([CASE WHEN {cal} > 0 AND {cal} < 100 THEN {q(r['low_cal'])} "
             f"WHEN {cal} > 500 THEN {q(r['high_cal'])} END, "
             f"CASE WHEN {p} > 0 AND {p} < 5 THEN {q(r['low_protein'])} "
             f"WHEN {p} > 20 THEN {q(r['high_protein'])} END, "
             f"CASE WHEN {c} > 50 THEN {q(r['high_carbs'])} END, "
             f"CASE WHEN {f} > 15 THEN {q(r['high_fat'])} END], lambda x: x IS NOT NULL)")
    return f"CASE WHEN len({items}) = 0 THEN [{q(r['default'])}] ELSE {items} END"
