"""Projections, filters and predicates, all DataFrame -> DataFrame.

Every filter is a plain Catalyst predicate so Parquet pushdown and partition
pruning apply; none reads the clock (``as_of`` is an argument).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.timeutil import lit_date

# Named relative ranges and their length in days.
RANGE_DAYS = {"today": 0, "week": 7, "month": 30, "quarter": 90, "year": 365}
# Tiers entitled to premium features.
PREMIUM_TIERS = ("Premium", "VIP")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def for_entity(df: DataFrame, col: str, entity_id=None) -> DataFrame:
    """Optional equality on an entity key (None = every entity)."""
    return df if entity_id is None else df.filter(F.col(col) == F.lit(entity_id))


def range_start(name: str, as_of) -> Column | None:
    """Lower bound of a named range, or None for ``all``/unknown."""
    if name not in RANGE_DAYS:
        return None
    return F.date_sub(lit_date(as_of), RANGE_DAYS[name])


def date_range(df: DataFrame, col: str, name: str, as_of) -> DataFrame:
    """``col >= as_of - n days`` for today/week/month/quarter/year; ``all`` keeps every row."""
    lo = range_start(name, as_of)
    return df if lo is None else df.filter(F.col(col) >= lo)


def date_range_closed(df: DataFrame, col: str, name: str, as_of) -> DataFrame:
    """Closed range ending at ``as_of``; ``month`` is the calendar month back."""
    hi = lit_date(as_of)
    if name == "today":
        return df.filter(F.col(col) == hi)
    if name == "week":
        return df.filter(F.col(col).between(F.date_sub(hi, 7), hi))
    if name == "month":
        return df.filter(F.col(col).between(F.add_months(hi, -1), hi))
    return df


def between_dates(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """P5: inclusive range, applied only when both bounds are given."""
    if lo is None or hi is None:
        return df
    return df.filter(F.col(col).between(lit_date(lo), lit_date(hi)))


def search(df: DataFrame, term: str | None, cols) -> DataFrame:
    """Case-insensitive ``%term%`` over several columns (``%``/``_`` stay wildcards)."""
    if not term:
        return df
    pattern = f"%{term}%"
    cond = reduce(lambda a, b: a | b, [F.coalesce(_c(c).ilike(pattern), F.lit(False)) for c in cols])
    return df.filter(cond)


def opt_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality unless the value is None or the ``all`` sentinel."""
    if value is None or value == "all":
        return df
    return df.filter(F.col(col) == F.lit(value))


def with_ids(df: DataFrame, col: str, ids) -> DataFrame:
    """IN list for a short literal list; use a left_semi join for long lists."""
    if isinstance(ids, DataFrame):
        key = ids.columns[0]
        return df.join(ids.select(F.col(key).alias(col)).distinct(), col, "left_semi")
    return df.filter(F.col(col).isin(list(ids)))


def active_sessions(df: DataFrame) -> DataFrame:
    """P10: not cancelled (case-insensitive)."""
    return df.filter(F.lower(F.col("status")) != "cancelled")


def on_day(df: DataFrame, ts_col: str, as_of) -> DataFrame:
    """Calendar-day equality as a half-open range so Parquet min/max stats prune."""
    lo = lit_date(as_of).cast("timestamp_ntz")
    hi = F.date_add(lit_date(as_of), 1).cast("timestamp_ntz")
    return df.filter((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def valid_sessions(df: DataFrame) -> DataFrame:
    """Drop rows with missing or falsy required fields."""
    req = [F.col(c).isNotNull() for c in ("id", "member_id", "coach_id", "session_date",
                                           "session_time", "duration", "status", "notes")]
    falsy = [(F.col("id") != 0), (F.col("member_id") != 0), (F.col("coach_id") != 0),
             (F.col("duration") != 0), (F.length("session_time") > 0),
             (F.length("status") > 0), (F.length("notes") > 0)]
    return df.filter(reduce(lambda a, b: a & b, req + falsy))


def entitled(df: DataFrame, col: str = "membership_type", tiers=PREMIUM_TIERS) -> DataFrame:
    """Members whose tier unlocks a feature."""
    return df.filter(F.col(col).isin(list(tiers)))


def upcoming(df: DataFrame, as_of, col: str = "session_date") -> DataFrame:
    """On or after ``as_of``."""
    return df.filter(F.col(col) >= lit_date(as_of))


def to_nested_session(df: DataFrame, keep=()) -> DataFrame:
    """The reference's nested session record as struct columns, after the columns ``keep``."""
    return df.select(
        *keep, "id",
        F.struct(F.col("member_id").alias("id"), F.col("member_name").alias("name")).alias("member"),
        F.struct("session_date", "session_time", "duration", "status").alias("schedule"),
        F.struct(F.col("workout_type").alias("type"), F.col("exercises")).alias("workout"),
    )
