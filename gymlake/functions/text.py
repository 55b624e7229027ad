"""Small text predicates and transforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MESSAGE_CHARS = 1000  # fixed value: message body limit


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (tabs too)."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^\s+", ""), r"\s+$", "")


def valid_email(c) -> Column:
    """the reference's shape check: contains ``@`` and ``.``."""
    c = _c(c)
    return F.coalesce(c.contains("@") & c.contains("."), F.lit(False))


def valid_message(c) -> Column:
    """non-blank after strip and at most 1000 characters."""
    n = F.length(strip(c))
    return F.coalesce((n > 0) & (n <= MAX_MESSAGE_CHARS), F.lit(False))


def split_name(c) -> Column:
    """struct(first_name, last_name) from ``name.split(' ', 1)``."""
    parts = F.split(_c(c), " ", 2)
    return F.struct(parts.getItem(0).alias("first_name"),
                    F.coalesce(F.get(parts, 1), F.lit("")).alias("last_name"))


def cap_first(c) -> Column:
    """F8: upper-case the first character, keep the rest."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def coalesce_food_name(custom_name, catalogue_name) -> Column:
    """First non-null food name."""
    return F.coalesce(_c(custom_name), _c(catalogue_name))


def plan_status(is_active) -> Column:
    """Boolean to ``active`` / ``inactive``."""
    return F.when(_c(is_active), F.lit("active")).otherwise(F.lit("inactive"))


def normalise_enum(c, values) -> Column:
    """Case-insensitive enum: map any casing to the canonical spelling, else NULL."""
    c = _c(c)
    expr = None
    for v in values:
        cond = F.lower(c) == v.lower()
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr
