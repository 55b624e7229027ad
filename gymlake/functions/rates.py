"""Rates, clamped ratings and capacity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(done, total, dp: int = 1, mode: str = "half_even") -> Column:
    """``done / total * 100`` rounded to ``dp`` places; NULL when total is 0.

    ``half_even`` reproduces Python ``round``; ``half_up`` reproduces SQL ``ROUND``.
    """
    pct = F.try_divide(_c(done).cast("double") * 100.0, _c(total).cast("double"))
    return F.bround(pct, dp) if mode == "half_even" else F.round(pct, dp)


def rate_or_zero(done, total, dp: int = 1, mode: str = "half_even") -> Column:
    """A8 where the reference guards ``if total > 0 else 0``."""
    return F.coalesce(rate(done, total, dp, mode), F.lit(0.0))


def performance_rating(completion_rate, default: float = 85.0) -> Column:
    """``min(100, max(60, rate + 20))``, 85 when there is no rate."""
    r = _c(completion_rate).cast("double")
    return F.when(r.isNull(), F.lit(default)).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(60.0), r + 20.0)))


def capacity(n, ideal: int = 100) -> Column:
    """Utilisation against an ideal head count, capped at 100 %."""
    return F.least(F.lit(100.0), _c(n).cast("double") / float(ideal) * 100.0)
