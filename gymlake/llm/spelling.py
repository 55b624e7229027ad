"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Two words are near when they differ by exactly one inserted, deleted or replaced code point.  A
word (the shorter one, or either of two equally long ones) contributes two disjoint chunks, its
halves; the other contributes its positional grams.  One edit leaves one chunk whole, so near
words share a chunk at the same place, or shifted by one behind an insertion.  A half alone is
far too common a key (on 0.5 GB of text 326 million pairs share their first half, growing with
the square of the vocabulary), so the rule is applied again inside the half that holds the edit:
its halves are chunks of which one is whole, and once more in words of over 12 code points.  A
key is thus everything but one small open part of the word, and the join compares open parts only:

  * equally long words: the same part is open in both, with one replaced code point;
  * one longer by one: its grams behind the open part are shifted by one, the part has one more.

The join's condition verifies a pair and takes it at its first open part, so no pair comes twice
and no candidate leaves the join.  Word numbers follow (count, word) order, so the most frequent
near word of a word is the smallest number.

``form`` is that near word if its count is at least ``ratio`` times the word's own; ``root``
follows forms to the end by pointer jumping (a step multiplies the count by ``ratio``, so chains
are short and end).

Results for odd input: null and empty texts have no words; a null doc_id counts as an empty
string in the typo rule of ``occurrences``; repeated rows count each; a run of letters may be as
long as a text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import stored
from gymlake.llm.license_scan import LOWER, UPPER

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, TYPO = 7, 2, 10, 31


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, typo: int | None = None) -> DataFrame:
    """One row (word) per maximal run of letters of at least ``min_length`` code points, lower-cased
    in A-Z.  With ``typo``, a run whose crc32 of ``<doc_id>:<run>`` that number divides loses code
    point crc32 % length; what is then too short goes."""
    # a deletion only shortens, so shorter runs never count
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = docs.select(doc.alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("word"))
    if typo is None:
        return words.select("word")
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return (words.select("word", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")).alias("h"))
            .select(F.when(F.col("h") % typo == 0, less).otherwise(F.col("word")).alias("word"))
            .where(F.length("word") >= min_length))


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Stored (id, word, n): the distinct words, numbered by falling count, then by word."""
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "spelling-words")
    return stored(counted.orderBy(F.desc("n"), "word")
                  .select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-ids")


def open_parts(words: DataFrame, length: Column) -> DataFrame:
    """``words`` once for each open part [a, b) of a word of ``length`` code points."""
    parts = F.when(length <= 6, 2).when(length <= 12, 4).otherwise(8)
    return (words.withColumn("length", length).withColumn("parts", parts)
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("a", F.expr("CAST(i * length DIV parts AS INT)"))
            .withColumn("b", F.expr("CAST((i + 1) * length DIV parts AS INT)")))


def keys(vocab: DataFrame, longer: bool) -> DataFrame:
    """(id, a, key, part, longer): all grams outside each open part as one key, and the part.

    ``longer``: as a partner of words shorter by one, grams behind the part shifted by one.
    """
    extra = int(longer)
    cut = open_parts(vocab, F.length("word") - extra)
    width = F.col("b") - F.col("a")
    rest = F.substring("word", F.col("b") + (extra + 1), F.col("length"))
    return cut.select(
        "id", "a", F.concat(F.substring("word", F.lit(1), F.col("a")), F.repeat(F.lit("*"), width), rest).alias("key"),
        F.substring("word", F.col("a") + 1, width + extra).alias("part"), F.lit(longer).alias("longer"))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(x, y): each unordered pair of near words once, by their numbers."""
    same, shifted = keys(vocab, False), keys(vocab, True)
    x = same.select("a", "key", F.col("id").alias("x"), F.col("part").alias("px"))
    y = same.union(shifted).select("a", "key", F.col("id").alias("y"), F.col("part").alias("py"), "longer")
    # (a, key) fixes the open part: the key's length is the shorter word's
    return (x.join(y, ["a", "key"])
            .where(F.col("longer") | (F.col("x") < F.col("y")))
            .where(F.levenshtein("px", "py", 1) == 1)
            # an insertion at a border fits two parts: the first one counts
            .where(~(F.col("longer") & (F.col("a") > 0) & (F.expr("substring(py, 2)") == F.col("px"))))
            .select("x", "y"))


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of a stored vocabulary: word, form, root, n, n_near, form_n."""
    both = near_pairs(vocab).select(F.explode(F.array(
        F.struct(F.col("x").alias("id"), F.col("y").alias("other")),
        F.struct(F.col("y").alias("id"), F.col("x").alias("other")))).alias("p")).select("p.*")
    near = both.groupBy("id").agg(F.min("other").alias("best"), F.count("*").alias("n_near"))
    best = vocab.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = stored(vocab.join(near, "id", "left").join(best, "best", "left")
                   .withColumn("has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
                   .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           *[F.when(F.col("has"), F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "spelling-forms")
    roots = stored(known.where(F.col("best").isNotNull()).select("id", F.col("best").alias("root")), "spelling-roots")
    while True:
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(up, "root", "left")
                      .select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            break
        roots = step.select("id", "root")
    last = vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ends = roots.join(last, "root").select("id", "root_word")
    return (known.join(ends, "id", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      typo: int | None = None) -> DataFrame:
    """Words of all texts with their near words counted, their form and root."""
    return variants(vocabulary(occurrences(docs, min_length, typo), min_count), ratio)
