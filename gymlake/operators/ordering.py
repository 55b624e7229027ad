"""Ordering, limits, per-key pages and suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.timeutil import WEEKDAYS
from gymlake.operators.filters import search


def order_sessions(df: DataFrame, ascending: bool = True) -> DataFrame:
    """O1: date then time (then id, so ties are stable)."""
    cols = ["session_date", "session_time", "id"]
    return df.orderBy(*[F.asc(c) if ascending else F.desc(c) for c in cols])


def weekday_order(col: str = "day_of_week"):
    """O2: MySQL ``FIELD(day, 'Monday', ...)`` as a sort key."""
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(col))


def top(df: DataFrame, order, n: int) -> DataFrame:
    """O3: global top-n (planned as TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def paginate(df: DataFrame, by, order, page: int = 1, limit: int = 20,
             max_limit: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """Page ``page`` of every key's rows plus total, has_more and total_pages.
    A limit over ``max_limit`` is an error.  ``counted`` may give a narrower frame with
    the same keys to count.

    Rows past ``page * limit`` never leave their map task: the row_number filter
    becomes a WindowGroupLimit below the shuffle.  Totals come from a partial
    aggregate, so even a key holding a third of all rows is never sorted whole.
    """
    by = [by] if isinstance(by, str) else list(by)
    limit, page = int(limit), int(page)
    if not 1 <= limit <= max_limit or page < 1:
        raise ValueError(f"page must be at least 1 and limit between 1 and {max_limit}")
    hi = page * limit
    w = Window.partitionBy(*by).orderBy(*order)
    rows = (df.withColumn("row_in_group", F.row_number().over(w))
            .filter(F.col("row_in_group") <= hi)
            .filter(F.col("row_in_group") > hi - limit))
    totals = (df if counted is None else counted).groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return (rows.join(totals, by)
            .withColumn("page", F.lit(page))
            .withColumn("has_more", F.col("total") > F.lit(hi))
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("int")))


def deep_page(df: DataFrame, by, order, slices: int, page: int = 1, limit: int = 20, max_limit: int = 1000) -> DataFrame:
    """O4 for pages far from the start; same rows and columns as ``paginate``.  ``order`` lists
    (column, ascending) and must end in a unique column.  Rows with a NULL key have pages too.

    Rows are counted per key and value of the first ``slices`` order columns; running counts tell
    which slices of a key hold its page, and only their rows are shuffled and sorted, whereas
    ``paginate`` ships ``page * limit`` rows a key from each map task.  Totals come from the same
    counts.  A page's rows are then those of the slices at its place, so choose columns whose
    values have few rows a key (a date and a time)."""
    by = [by] if isinstance(by, str) else list(by)
    limit, page = int(limit), int(page)
    if not 1 <= limit <= max_limit or page < 1 or not 1 <= slices <= len(order):
        raise ValueError(f"page must be at least 1, limit between 1 and {max_limit}, slices between 1 and {len(order)}")
    hi, lo = page * limit, (page - 1) * limit
    directed = [F.asc(c) if ascending else F.desc(c) for c, ascending in order]
    keys = by + [c for c, _ in order[:slices]]
    key = Window.partitionBy(*by)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spans = (counts.withColumn("_end", F.sum("_n").over(key.orderBy(*directed[:slices]).rowsBetween(
                 Window.unboundedPreceding, Window.currentRow)))
             .withColumn("total", F.sum("_n").over(key)))
    here = (spans.where((F.col("_end") > lo) & (F.col("_end") - F.col("_n") < hi))
            .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                    (F.col("_end") - F.col("_n")).alias("_before"), "total"))
    matches = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    rows = df.join(here, matches).drop(*[f"_k{i}" for i in range(len(keys))])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(directed[slices:] or directed)))
    return (rows.withColumn("row_in_group", (F.col("_before") + rank).cast("int")).drop("_before")
            .where((F.col("row_in_group") > lo) & (F.col("row_in_group") <= hi))
            .withColumn("page", F.lit(page))
            .withColumn("has_more", F.col("total") > F.lit(hi))
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("int")))


def suggest(df: DataFrame, term: str, cols, order, n: int = 5) -> DataFrame:
    """First ``n`` matches, only for terms of two or more characters."""
    if not term or len(term) < 2:
        return df.limit(0)
    return search(df, term, cols).orderBy(*order).limit(n)
