"""Substring search by an inverted index of q-grams, verified exactly.

``gram_index`` holds, for each row, the distinct substrings of its lower-cased texts in the sizes
that are asked for (size 0 is the empty one).  Every row that contains a term contains all grams of
the term, so one gram finds all matches: the longest, of those the rarest (by the index's own counts).
A search without a stored index makes one for its terms: of the sizes of their longest parts, up to
``LONGEST`` characters, so a term of that length or less is looked up whole and its candidates grow
as its matches do.  (Grams of one fixed size are each in a fixed share of the rows, and terms times
candidates grow as the square.)  A stored index has the sizes it was made with.
Candidates are verified inside the join's condition, so none leaves it; there is no nested loop and
no limit.  Terms may hold the wildcards ``%`` and ``_`` of P6: grams come from the parts between
them, and a term of wildcards only has the empty gram.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.operators.attendance import latest_n
from gymlake.sources.keyed import KeyedTable

GRAM = 3
# Sizes of an index made without knowing the terms.
SIZES = tuple(range(GRAM + 1))
# Longest gram: a longer term is looked up by the rarest of its grams of this size.
LONGEST = 8
# Up to so many distinct grams (about 100 bytes each) are broadcast to thin out an index.
BROADCAST_GRAMS = 1_000_000


def _substrings(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters (none of shorter texts)."""
    n = F.length(text) - F.lit(size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))


def _grams(text: Column, sizes) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.coalesce(_substrings(text, k), none) for k in sizes])


def _grams_of(size: int) -> Callable[[Column], Column]:
    return lambda text: _grams(text, [size])


def gram_index(rows: DataFrame, id_col: str, text_cols, sizes=SIZES) -> DataFrame:
    """Rows (gram, id), each once, with grams of the given ``sizes``; a row whose texts are all NULL has none."""
    empty = [F.array(F.lit(""))] if 0 in sizes else []
    grams = [F.when(F.col(c).isNotNull(), F.concat(*empty, _grams(F.lower(c), [k for k in sizes if k]))) for c in text_cols]
    none = F.array().cast("array<string>")
    # a row becomes many: rows are dealt over all tasks before, as a scan may be a single task
    return rows.repartition(id_col).select(F.col(id_col).alias("id"),
                                           F.explode(F.array_distinct(F.concat(*[F.coalesce(g, none) for g in grams]))).alias("gram")).distinct()


def store_index(index: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """The index in buckets of its grams: a search for few terms reads their buckets only."""
    return KeyedTable.create(index.select("gram", "id"), path, "gram", buckets)


def term_grams(terms: DataFrame, term_col: str, wildcards: bool = True, sizes=SIZES) -> DataFrame:
    """Rows (all columns of ``terms``, gram): the grams of the greatest of ``sizes`` that the term has.
    NULL terms have none; empty ones, and those of wildcards only, the empty gram."""
    parts = F.split(F.lower(term_col), r"[%_\\]") if wildcards else F.array(F.lower(term_col))
    by_size = [F.array_distinct(F.flatten(F.transform(parts, _grams_of(k)))) for k in sorted(sizes, reverse=True) if k]
    chosen = reduce(lambda rest, g: F.when(F.size(g) > 0, g).otherwise(rest), reversed(by_size), F.array(F.lit("")))
    return terms.where(F.col(term_col).isNotNull()).select("*", F.explode(chosen).alias("gram"))


def gram_sizes(terms: DataFrame, term_col: str, wildcards: bool = True, sizes=range(LONGEST + 1)) -> dict[int, int]:
    """How many distinct grams of each size the terms are looked up by: at most one number a size."""
    grams = term_grams(terms.select(term_col).distinct(), term_col, wildcards, sizes).select("gram").distinct()
    return {r[0]: r[1] for r in grams.groupBy(F.length("gram")).agg(F.count(F.lit(1))).collect()}


def probes(terms: DataFrame, term_col: str, index: DataFrame, wildcards: bool = True, sizes=SIZES) -> DataFrame:
    """The ``terms`` (rows of their own) with the rarest of their grams; terms with a gram that the
    index does not hold are in no row and drop out here."""
    grams = term_grams(terms.distinct(), term_col, wildcards, sizes)
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    return _rarest(terms.columns, grams, counts)


def _rarest(columns: list[str], grams: DataFrame, counts: DataFrame) -> DataFrame:
    found = grams.join(counts, "gram", "left")
    best = found.groupBy(*columns).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_b"))
    return best.where("_b.n > 0").select(*columns, F.col("_b.gram").alias("gram"))


def matches(terms: DataFrame, term_col: str, rows: DataFrame, id_col: str, text_cols, holds: Callable[[Column, Column], Column],
            index: DataFrame | None = None, wildcards: bool = True, sizes=SIZES) -> DataFrame:
    """Rows (columns of ``terms``, columns of ``rows``) of every term and row with
    ``holds(text, term)`` for one of ``text_cols``.  ``index`` may be a stored one of the same rows,
    with grams of ``sizes``.  A row id must be unique; equal terms are one."""
    asked = gram_sizes(terms, term_col, wildcards, sizes if index is not None else range(LONGEST + 1))
    if index is None:
        index, sizes = gram_index(rows, id_col, text_cols, sorted(asked)), sorted(asked)
    grams = term_grams(terms.distinct(), term_col, wildcards, sizes)
    wanted = grams.select("gram").distinct()
    # only the asked grams are shuffled.  Sizes are guessed from compressed files and an explode is not
    # counted, so no side of a join that grows with the rows is left to be broadcast by a guess.
    few = sum(asked.values()) <= BROADCAST_GRAMS
    held = index.join(F.broadcast(wanted) if few else wanted.hint("merge"), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    found = (_rarest(terms.columns, grams, counts).join(held.hint("merge"), "gram")
             .drop("gram").withColumnRenamed("id", "_id"))
    # the renamed copy of the term keeps clear of a column of ``rows`` with its name
    verified = reduce(lambda a, b: a | b, [F.coalesce(holds(F.col(c), F.col(term_col)), F.lit(False)) for c in text_cols])
    return found.join(rows.hint("merge"), (found["_id"] == rows[id_col]) & verified).drop("_id")


def like_anywhere(text: Column, term: Column) -> Column:
    """Case-insensitive ``%term%``; ``%`` and ``_`` in the term stay wildcards."""
    return F.call_function("like", F.lower(text), F.concat(F.lit("%"), F.lower(term), F.lit("%")))


def search_terms(terms: DataFrame, rows: DataFrame, id_col: str, text_cols, index: DataFrame | None = None, sizes=SIZES) -> DataFrame:
    """P6/P8 for a table of terms: (term, row) for each row that a term finds; empty terms find all."""
    return matches(terms, "term", rows, id_col, text_cols, like_anywhere, index, sizes=sizes)


def suggest_terms(terms: DataFrame, rows: DataFrame, id_col: str, text_cols, order, n: int = 5,
                  index: DataFrame | None = None, sizes=SIZES) -> DataFrame:
    """O5 for a table of terms: the first ``n`` matches of each term of two or more characters."""
    return latest_n(search_terms(terms.where(F.length("term") >= 2), rows, id_col, text_cols, index, sizes), "term", order, n)


def first_hits(labels: DataFrame, foods: DataFrame) -> DataFrame:
    """J20 for a list that is a table: per label (column ``label``) the food (``food_id``,
    ``food_name``) of smallest id whose name is contained in the label or contains it, in any case;
    labels without one have NULLs.  Both directions are looked up by grams of the contained side."""
    texts = labels.select("label").where("label IS NOT NULL").distinct()
    named = foods.where("food_name IS NOT NULL").groupBy("food_name").agg(F.min("food_id").alias("food_id"))
    # lower-cased copies, each once: they are the ids of the two indexes
    inside = matches(named.select(F.lower("food_name").alias("food")), "food", texts.select(F.lower("label").alias("low")).distinct(),
                     "low", ["low"], lambda text, term: text.contains(term), wildcards=False)
    around = matches(texts.select(F.lower("label").alias("low")), "low", named.select(F.lower("food_name").alias("food")).distinct(),
                     "food", ["food"], lambda text, term: text.contains(term), wildcards=False)
    ids = named.groupBy(F.lower("food_name").alias("food")).agg(F.min(F.struct("food_id", "food_name")).alias("hit"))
    first = (inside.select("low", "food").unionByName(around.select("low", "food")).join(ids, "food")
             .groupBy("low").agg(F.min("hit").alias("hit")))
    return (labels.withColumn("low", F.lower("label")).join(first, "low", "left").drop("low")
            .select(*labels.columns, "hit.food_id", "hit.food_name"))
