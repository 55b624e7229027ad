"""Quality rules as a bitmask ledger: every rule is evaluated once, policies come after.

``measure`` reads each whole text once and counts; ``ledger`` turns the counts into one bit a
failed rule and stores bits and measurements, without the texts.  ``judge`` then applies
versioned policies (each a mask of rules) by ``bits & mask``, and ``ablation`` answers for every
policy and rule how many rows the rule fails, fails alone, and would give back if it were left
out, from counts per distinct bit pattern (at most 2 ** rules rows), never from the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``.  Measurements of a text:

  n_chars, n_words, word_chars   code points, words, code points in words
  n_symbols                      characters of ``[#*$%&|<>]``
  n_lines, n_dup_lines           \\n-split lines with a word; those equal to an earlier line
  n_repeat_words                 words in 5-word windows found twice or more (first included)
  n_echo_words                   words equal to the word before them
  longest_word                   bytes of the longest word

Windows are compared by 64-bit hashes first; windows that look equal are then compared word by
word, so ``n_repeat_words`` is exact (``n_echo_words`` compares the words' 64-bit hashes).  A text beyond ``PART`` bytes is split in words part by part: a
worker holds the text, 8 bytes a word and, for repeated windows only, their places.

Results for odd input: a null or empty text has no words, so all counts are 0 and it fails
``few_words``; a null doc_id is kept; repeated rows are judged each; an empty table gives an
empty ledger and an ablation of zeros; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, stored

WINDOW = 5
PART = 4 << 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words",
          "longest_word"]
_CUT = re.compile(rb"[ \t-\r]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True

# Rules: name, and when a row fails it (never null).  A rule's place is its bit, for good: new
# rules are appended, so stored ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),  # a text of three lines may repeat one
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 AND word_chars > 20 * n_words"),
    ("endless_word", "longest_word > 1000"),
    ("echoed_words", "100 * n_echo_words > 30 * n_words"),
]


@dataclass(frozen=True)
class Policy:
    """A version of the filter: the rules whose failure drops a row."""
    version: str
    rules: tuple[str, ...]


BASE = Policy("base", ("few_words", "repeated_windows"))
LINES = Policy("v1", BASE.rules + ("symbols", "repeated_lines"))
CURRENT = Policy("v2", LINES.rules + ("short_words", "long_words", "endless_word", "echoed_words"))
POLICIES = (BASE, LINES, CURRENT)


def parts(text: bytes, most: int):
    """The text in pieces that end behind a blank character (one word is never cut)."""
    i = 0
    while len(text) - i > most:
        cut = _CUT.search(text, i + most)
        if cut is None:
            break
        yield text[i:cut.end()]
        i = cut.end()
    yield text[i:] if i else text


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def repeated_words(text: bytes, hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice in the text."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = _mixed(roll + hashes[k:k + n])
    order = np.argsort(roll, kind="stable")
    ranked = roll[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    blank = _IS_BLANK[np.frombuffer(text, np.uint8)]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    start = np.append(start, len(text))

    def words(i):
        return text[start[i]:start[i + window]].split()

    if all(words(i) == words(j) for i, j in zip(a.tolist(), b.tolist())):
        hit = np.zeros(n, bool)
        hit[a] = hit[b] = True
    else:  # two different windows share a hash: compare all that share one by their words
        found: dict[tuple, list[int]] = {}
        for i in np.union1d(a, b).tolist():
            found.setdefault(tuple(words(i)), []).append(i)
        hit = np.zeros(n, bool)
        for places in found.values():
            hit[places] = len(places) > 1
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[:n] += hit
    edge[window:window + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes, part: int = PART) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``COUNTS``."""
    n_chars = len(text.decode())
    hashes, longest, total = [], 0, 0
    for piece in parts(text, part):
        words = piece.split()
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        longest = max(longest, max(map(len, words), default=0))
        total += len(words)
    held = np.concatenate(hashes).view(np.uint64)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    blanks = sum(text.count(bytes([c])) for c in BLANKS)
    return (n_chars, total, n_chars - blanks, sum(text.count(bytes([c])) for c in SYMBOLS),
            len(lines), len(lines) - len(set(lines)), repeated_words(text, held),
            int((held[1:] == held[:-1]).sum()), longest)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements of each row's whole ``text``."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = kept.select(*keep, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            found = [counts(t.as_py()) for t in texts]
            columns = list(zip(*found)) if found else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(c, pa.int64()) for c in columns], names=[*keep, *COUNTS])

    return kept.mapInArrow(run, schema)


def failure_bits(rules: list[tuple[str, str]] | None = None) -> Column:
    """One long: bit k is set where rule k fails."""
    rules = RULES if rules is None else rules
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask_of(policy: Policy, rules: list[tuple[str, str]] | None = None) -> int:
    at = {name: k for k, (name, _) in enumerate(RULES if rules is None else rules)}
    unknown = set(policy.rules) - set(at)
    if unknown:
        raise ValueError(f"policy {policy.version} names unknown rules: {sorted(unknown)}")
    return sum(1 << at[name] for name in set(policy.rules))


def ledger(docs: DataFrame, rules: list[tuple[str, str]] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored ledger: ``keep`` columns, measurements, and ``bits``."""
    return stored(measure(docs, keep).withColumn("bits", failure_bits(rules)), "quality-ledger")


def judge(held: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` a policy."""
    return held.select("*", *[(F.col("bits").bitwiseAND(F.lit(mask_of(p, rules))) == 0).alias(f"kept_{p.version}")
                              for p in policies])


def ablation(held: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per policy and rule in it: version, rule, dropped (by the policy), fails (the rule),
    alone (only this rule of the policy: the rows that leaving it out gives back)."""
    rules = RULES if rules is None else rules
    spark = held.sparkSession
    at = {name: k for k, (name, _) in enumerate(rules)}
    todo = [(p.version, r, mask_of(p, rules), 1 << at[r]) for p in policies for r in dict.fromkeys(p.rules)]
    patterns = held.groupBy("bits").agg(F.count("*").alias("n"))  # at most 2 ** len(rules) rows
    asked = spark.createDataFrame(todo, "version string, rule string, mask long, bit long")
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    per = (patterns.withColumn("ask", F.explode(F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                 F.lit(b).cast("long").alias("bit")) for v, r, m, b in todo])))
        .select("bits", "n", "ask.*")
        .groupBy("version", "rule")
        .agg(F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("dropped"),
             F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
             F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("alone")))
    zero = F.lit(0).cast("long")
    return (asked.join(per, ["version", "rule"], "left")
            .select("version", "rule", *[F.coalesce(c, zero).alias(c) for c in ("dropped", "fails", "alone")]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measurements, bits, base_failed, kept (by the current
    policy) and one verdict a policy version."""
    held = ledger(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    judged = judge(held)
    return judged.select("doc_id", *COUNTS, "bits", (~F.col(f"kept_{BASE.version}")).alias("base_failed"),
                         (F.col(f"kept_{BASE.version}") & F.col(f"kept_{CURRENT.version}")).alias("kept"),
                         *[f"kept_{p.version}" for p in POLICIES])


def oracle_sql() -> str:
    """The same for ``documents`` in DuckDB, window by window."""
    bits = " + ".join(f"(CASE WHEN {fails} THEN {1 << k} ELSE 0 END)" for k, (_, fails) in enumerate(RULES))
    kept = ", ".join(f"(bits & {mask_of(p)}) = 0 AS kept_{p.version}" for p in POLICIES)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, w[i : i + {WINDOW - 1}] AS v
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
g AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range({WINDOW}) AS o(k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, doc_id, length(t) AS n_chars, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words,
             coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest_word FROM d),
m AS (SELECT c.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM c LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS bits FROM m)
SELECT doc_id, {", ".join(COUNTS)}, bits, (bits & {mask_of(BASE)}) <> 0 AS base_failed,
       (bits & {mask_of(BASE) | mask_of(CURRENT)}) = 0 AS kept, {kept}
FROM b
"""
