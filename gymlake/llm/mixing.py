"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form a queue of blocks (``block_docs`` documents, in hash order).
Target weights are integer shares; in a period of as many slots as the shares of the active
sources add up to, the j-th block of a source with share s of S becomes ready at slot
floor(j S / s) and is due by slot ceil((j + 1) S / s), and each slot goes to the ready block
that is due earliest.  So after any number of slots a source has had less than one block
more or less than its weight asks for.  When a source has given all its blocks, the next
phase goes on with the shares of the others, so every document gets its place.

The schedule of one period per phase (shares, not rows) is computed on the driver; places in
the sources' queues are counted in hash buckets, so no source, however large, is in one task.

Results for odd input: a null source is a source of its own; a source without a weight has
share 1; a null or repeated doc_id gets a place per row (rows with equal doc_id in any
order); an empty table gives an empty result; other columns are passed through, except those
named like the added ones, which are replaced.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import sized, stored

BLOCK_DOCS = 8
BUCKET_ROWS = 20_000  # rows of one hash bucket of the queues, about


def pfair_period(shares: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """One period: (source, block of the period, release, deadline) of each slot.

    Ties go to the larger share, then the smaller name.
    """
    total = sum(shares.values())
    waiting = sorted((0, s) for s, n in shares.items() if n > 0)
    turn = dict.fromkeys(shares, 0)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            n, j = shares[s], turn[s]
            heapq.heappush(ready, (-(-(j + 1) * total // n), -n, s, release))
        deadline, _, s, release = heapq.heappop(ready)
        out.append((s, turn[s], release, deadline))
        turn[s] += 1
        if turn[s] < shares[s]:
            heapq.heappush(waiting, (max(turn[s] * total // shares[s], slot + 1), s))
    return out


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """Phases of the schedule: whole periods of the active sources, until one of them has no
    full turn left.  Each: first slot, periods, shares, and blocks given before, by source.

    Where a source has less left than its share, one period of unchanged shares is cut behind
    the slot in which the first source runs out (``order``: its slots up to there), so no
    source is held back to the end of another.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    given = dict.fromkeys(left, 0)
    slot, out = 0, []
    while left:
        active = {s: shares[s] for s in left}
        periods = min(left[s] // n for s, n in active.items())
        order = None
        if periods:
            taken = {s: periods * n for s, n in active.items()}
        else:
            order = pfair_period(active)
            end = next(at for at, (s, j, *_) in enumerate(order) if j + 1 == left[s])
            order, periods = order[:end + 1], 1
            taken = Counter(s for s, *_ in order)
        out.append({"slot": slot, "periods": periods, "shares": active, "given": {s: given[s] for s in active},
                    "taken": {s: taken[s] for s in active}, "order": order})
        slot += sum(taken.values())
        for s in active:
            given[s] += taken[s]
            left[s] -= taken[s]
        left = {s: n for s, n in left.items() if n}
    return out


NO_SOURCE = "\x00none"


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with source_rank (place in its source), block, release, deadline (in slots
    from 0), slot and position (place of the document in the whole mix).

    ``weights``: integer share by source (default: 1 each).
    """
    spark = docs.sparkSession
    added = ["source_rank", "block", "release", "deadline", "slot", "position"]
    kept = [c for c in docs.columns if c not in added]
    # queues: rows of one source are spread over hash buckets
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    keyed = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("_mix_source"),
                        F.xxhash64(F.lit(17), F.col("doc_id")).alias("_mix_draw"))
    keyed = keyed.withColumn("_mix_bucket", F.shiftrightunsigned("_mix_draw", 33) % buckets)
    sizes = stored(keyed.groupBy("_mix_source", "_mix_bucket").agg(F.count("*").alias("n")), "mix-sizes")
    before = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_mix_source", "_mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before"))
    in_bucket = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_draw", "row.doc_id")
    ranked = (keyed.withColumn("_mix_row", F.row_number().over(in_bucket))
              .join(sized(offsets, sizes.count()), ["_mix_source", "_mix_bucket"])
              .withColumn("source_rank", F.col("_mix_before") + F.col("_mix_row") - 1)
              .withColumn("block", F.floor(F.col("source_rank") / block_docs)))

    # one row per source
    totals = {r["_mix_source"]: r["n"] for r in sizes.groupBy("_mix_source").agg(F.sum("n").alias("n")).collect()}
    shares = {s: max(1, int((weights or {}).get(None if s == NO_SOURCE else s, 1))) for s in totals}
    plan = phases({s: -(-n // block_docs) for s, n in totals.items()}, shares)
    if not plan:
        return docs.select(*kept, *[F.lit(None).cast("long").alias(c) for c in added]).limit(0)
    periods, slots = [], []
    for p, phase in enumerate(plan):
        total = sum(phase["shares"].values())
        for s, share in phase["shares"].items():
            first = phase["given"][s]
            periods.append((p, s, first, first + phase["taken"][s], share, phase["slot"], total))
        for at, (s, j, release, deadline) in enumerate(phase["order"] or pfair_period(phase["shares"])):
            slots.append((p, s, j, at, release, deadline))
    # as many rows as (sources) phases, and shares in them: no more with more documents
    in_phase = spark.createDataFrame(periods, "_phase int, _ps string, _first long, _end long, _share long, _slot0 long, _total long")
    in_slot = spark.createDataFrame(slots, "_sp int, _ss string, _j long, _at long, _release long, _deadline long")
    placed = (ranked.join(sized(in_phase, len(periods)),
                          (F.col("_mix_source") == F.col("_ps")) & F.col("block").between(F.col("_first"), F.col("_end") - 1))
              .withColumn("_turn", F.floor((F.col("block") - F.col("_first")) / F.col("_share")))
              .join(sized(in_slot, len(slots)),
                    (F.col("_phase") == F.col("_sp")) & (F.col("_mix_source") == F.col("_ss"))
                    & ((F.col("block") - F.col("_first")) % F.col("_share") == F.col("_j"))))
    base = F.col("_slot0") + F.col("_turn") * F.col("_total")
    # a slot holds block_docs documents, fewer only in the last block of a source: places are
    # slots times block_docs, and stay in slot order
    return (placed.withColumn("slot", base + F.col("_at")).withColumn("release", base + F.col("_release"))
            .withColumn("deadline", base + F.col("_deadline"))
            .withColumn("position", F.col("slot") * block_docs + F.col("source_rank") % block_docs)
            .select("row.*", *[F.col(c).cast("long").alias(c) for c in added]))


def in_mix_order(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of ``docs`` (same columns) laid out in the order of the mix, over range
    partitions: files written from it, read one after the other, are the mixed stream."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (mix(docs, weights).repartitionByRange(n, "position").sortWithinPartitions("position")
            .select(*docs.columns))
