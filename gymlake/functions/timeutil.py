"""Date and time helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in Monday-first order (weekday() index 0..6).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d) -> Column:
    return F.to_date(F.lit(str(d)))


def lit_ts(ts) -> Column:
    return F.to_timestamp_ntz(F.lit(str(ts)))


def fmt_date(c) -> Column:
    """ISO date text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def fmt_time(c) -> Column:
    """``HH:mm`` text from a timestamp."""
    return F.date_format(_c(c), "HH:mm")


def day_name(c) -> Column:
    """full weekday name (``Monday``)."""
    return F.date_format(_c(c), "EEEE")


def weekday_from_name(c) -> Column:
    """Index 0..6 of a weekday name (NULL when unknown)."""
    pos = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), _c(c)).cast("int")
    return F.when(pos > 0, pos - 1)


def to_hour(c) -> Column:
    """hour of ``HH:MM[:SS]`` text (NULL if unparsable)."""
    return F.split(_c(c), ":").getItem(0).try_cast("int")


def to_minutes(c) -> Column:
    """Minutes since midnight of ``HH:MM`` text."""
    parts = F.split(_c(c), ":")
    return parts.getItem(0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")


def start_ts(date_col, time_col) -> Column:
    """Session start as TIMESTAMP_NTZ from a DATE and ``HH:MM`` text."""
    return F.timestamp_add("MINUTE", to_minutes(time_col), _c(date_col).cast("timestamp_ntz"))


def week_start(c) -> Column:
    """Monday of the week containing ``c`` (D8: Monday-first)."""
    return F.date_sub(_c(c), F.weekday(_c(c)))


def next_occurrence(day_idx, hour, now) -> Column:
    """first ``day_idx`` weekday at ``hour``:00 strictly after ``now``."""
    now = _c(now)
    today = F.to_date(now)
    ahead = F.pmod(_c(day_idx) - F.weekday(today), F.lit(7))
    cand = F.timestamp_add("HOUR", _c(hour), F.date_add(today, ahead).cast("timestamp_ntz"))
    return F.when(cand <= now, F.timestamp_add("DAY", F.lit(7), cand)).otherwise(cand)


def hours_to_block(duration) -> Column:
    """``max(1, ceil(duration / 60))``."""
    return F.greatest(F.lit(1), F.ceil(_c(duration) / 60).cast("int"))
