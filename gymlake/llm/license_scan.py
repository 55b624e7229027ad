"""License scan: base phrases, and an exact set-similarity join of text blocks with templates.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z.  Base labels
come from phrases whose words stand consecutively.  For the join a text is cut into blocks of
2 * stride words, one every stride words, so that any run of up to stride words is whole in a
block; the stride is ``STRIDE``, or the longest template if that is longer.  A block has a
template's label when it holds at least ``THRESHOLD`` of the template's distinct words and all of
its deciding words (those that tell it from the templates of other licenses).  Template words are ordered by document frequency in the corpus,
rarest first; a pair is a candidate when it passes

  * the length filter: the block has enough template words at all,
  * the prefix filter: the first common word is early enough in both orders, and
  * the positional filter: enough words come after it in both;

candidates are then verified by intersecting the sets.  Words outside the templates are in no
intersection, so blocks carry only the others.  No Python code runs on the executors.

``score`` is 1 where a base phrase occurs, else the best containment of a matched template,
else 0.  Results for odd input: a null text is an empty one (0 words, no labels); a null
doc_id is kept; repeated rows are scanned each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import sized, stored

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Characteristic sentences of well-known licenses, as words.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0",
                   "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc0": ["has waived all copyright and related or neighboring rights to this work"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
}
# Words without which a template does not count, by label: wherever its texts have them.
DECIDING = {"apache-2.0": ["apache"], "cc-by-nc": ["nc"], "gpl-3.0": ["general", "version", "3"], "mit": ["mit"], "mpl-2.0": ["mozilla"]}
THRESHOLD = 0.8
STRIDE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of words (empty for an empty text)."""
    line = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER),
                                   r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def needed(m: int, threshold: float) -> int:
    """Common words that containment of a template of m distinct words takes."""
    return max(1, math.ceil(threshold * m - 1e-9))


def must(label: str, words, deciding: dict[str, list[str]]) -> list[str]:
    """The deciding words of a label that one of its templates has."""
    return [w for w in deciding.get(label, ()) if w in words]


def stride_of(templates: dict[str, list[str]], stride: int = STRIDE) -> int:
    """A stride no shorter than any template."""
    return max([stride, *(len(text.split()) for texts in templates.values() for text in texts)])


def base_hits(words: Column, base: dict[str, str]) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively."""
    def at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in base.items():
            head, *rest = phrase.split()
            here = w == head
            for k, other in enumerate(rest, 1):
                here = here & (F.get(words, i + k) == other)
            found = F.when(here, F.lit(label)).otherwise(found)
        return F.struct(i.cast("long").alias("start"), found.alias("label"))

    # places are looked up only where the words of some phrase are all there
    maybe = F.lit(False)
    for phrase in base:
        there = F.lit(True)
        for w in dict.fromkeys(phrase.split()):
            there = there & F.array_contains(words, w)
        maybe = maybe | there
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(maybe, F.filter(F.transform(words, at), lambda h: h["label"].isNotNull())).otherwise(none)


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
                 threshold: float = THRESHOLD, stride: int = STRIDE, deciding: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, tag (the number of the row in the scan)."""
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    deciding = DECIDING if deciding is None else deciding
    stride = stride_of(templates, stride)
    spark = docs.sparkSession
    sets = [(label, tuple(dict.fromkeys(text.split()))) for label, texts in templates.items() for text in texts]
    vocabulary = sorted({w for _, words in sets for w in words})
    scanned = docs.select(F.monotonically_increasing_id().alias("tag"), F.col("doc_id").cast("long").alias("doc_id"),
                          words_of(F.col("text")).alias("words"))

    def literal(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    # global order of the template words: document frequency, rarest first (as many rows as
    # the templates have words)
    seen = (scanned.select(F.explode_outer(F.array_intersect("words", literal(vocabulary))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).collect())
    often = {r["word"]: r["n"] for r in seen}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index, prefix_words = [], set()
    for t, (label, words) in enumerate(sets):
        order = sorted(rank[w] for w in words)
        need = needed(len(order), threshold)
        for i in range(len(order) - need + 1):
            index.append((t, label, order[i], i, len(order), need, order, [rank[w] for w in must(label, words, deciding)]))
            prefix_words.add(order[i])
    by_rank = sorted(rank, key=rank.get)
    rank_of = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))]) if rank else None

    # blocks of the texts that hold a prefix word, as sorted ranks of their template words
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / stride)).cast("int") - 1)
    none = F.array().cast("array<struct<block:int,ranks:array<int>>>")
    if index:
        blocks = F.when(
            F.arrays_overlap("words", literal(sorted(by_rank[i] for i in prefix_words))),
            F.filter(F.transform(starts, lambda b: F.struct(
                b.cast("int").alias("block"),
                F.array_sort(F.transform(F.array_intersect(F.slice("words", b * stride + 1, 2 * stride), literal(vocabulary)),
                                         lambda w: F.element_at(rank_of, w))).alias("ranks"))),
                lambda s: F.size(s["ranks"]) >= min(x[5] for x in index))).otherwise(none)
    else:
        blocks = none
    rows = stored(scanned.select("tag", "doc_id", n.cast("long").alias("n_words"),
                                 base_hits(F.col("words"), base).alias("hits"), blocks.alias("blocks")), "license-rows")

    matched = None
    if index:
        held = (rows.where(F.size("blocks") > 0).select("tag", F.explode("blocks").alias("b"))
                .select("tag", "b.block", "b.ranks", F.posexplode("b.ranks").alias("j", "word")))
        known = spark.createDataFrame(index, "template int, label string, word int, i int, m int, need int, words array<int>, must array<int>")
        size = F.size("ranks")
        candidates = (held.join(sized(known, len(index)), "word")
                      .where(size >= F.col("need"))                                              # length
                      .where(F.col("j") <= size - F.col("need"))                                 # prefix
                      .where(F.least(F.col("m") - F.col("i"), size - F.col("j")) >= F.col("need")))  # positional
        matched = (candidates.withColumn("common", F.size(F.array_intersect("ranks", "words")))
                   .where(F.col("common") >= F.col("need"))
                   .where(F.size(F.array_except("must", "ranks")) == 0)
                   .groupBy("tag").agg(F.collect_set("label").alias("found"),  # at most one per template
                                       F.max(F.col("common") / F.col("m")).alias("containment")))
    out = rows.withColumn("base", F.array_distinct(F.col("hits.label")))
    if matched is not None:
        out = out.join(matched, "tag", "left")
    else:
        out = out.withColumn("found", F.lit(None).cast("array<string>")).withColumn("containment", F.lit(None).cast("double"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"),
        F.array_min("hits.start").alias("first_word"), F.array_max("hits.start").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"), "tag")


def oracle_sql() -> str:
    """The same for ``documents`` in DuckDB, by comparing every block with every template."""
    def quoted(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"
    stride = stride_of(TEMPLATES)
    sets = ", ".join(f"('{label}', {quoted(dict.fromkeys(t.split()))}, {needed(len(set(t.split())), THRESHOLD)}, {quoted(must(label, t.split(), DECIDING))}::VARCHAR[])"
                     for label, texts in TEMPLATES.items() for t in texts)
    places = " UNION ALL ".join(
        f"SELECT tag, i - 1 AS start, '{label}' AS label FROM (SELECT tag, w, unnest(range(1, len(w) + 1)) AS i FROM d "
        f"WHERE list_has_all(w, {quoted(p.split())})) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in BASE.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS tag, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS ({places}),
hg AS (SELECT tag, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY tag),
t(label, words, need, must) AS (VALUES {sets}),
b AS (SELECT tag, list_distinct(w[k * {stride} + 1 : k * {stride} + {2 * stride}]) AS s
      FROM (SELECT tag, w, unnest(range(0, greatest(1, ceil(len(w) / {stride}))::BIGINT)) AS k FROM d)),
m AS (SELECT tag, label, max(len(list_intersect(s, words)) / len(words)) AS c FROM b, t
      WHERE len(list_intersect(s, words)) >= need AND list_has_all(s, must) GROUP BY tag, label),
mg AS (SELECT tag, max(c) AS c FROM m GROUP BY tag),
l AS (SELECT tag, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT tag, label FROM m UNION ALL SELECT tag, label FROM h) GROUP BY tag)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN hg USING (tag) LEFT JOIN l USING (tag) LEFT JOIN mg USING (tag)
"""
