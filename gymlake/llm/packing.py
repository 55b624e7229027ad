"""Best-fit packing of documents into fixed-length sequences by bin completion.

Documents become token ids (with an end id); only those longer than a sequence are cut,
into full sequences and one last piece.  A full piece is a sequence of its own.  The other
pieces are dealt at random into batches; each batch is packed by branch and bound:
best-fit decreasing gives the first incumbent, then bins are completed around the largest
piece that is left, with undominated fillings in order of waste, and a branch ends when
its waste exceeds what the incumbent less one sequence would allow.  The search ends early when
the incumbent meets a lower bound (of pieces too long to share a sequence, and of the total).  Sequences that batches
have left badly filled are packed anew together, in rounds.

Results for odd input: a null or empty text is one piece with just the end id; a null
doc_id is kept as it is; repeated rows are packed as often as they occur; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, numbered, sized, stored, tidied
from gymlake.llm.tokens import END_ID, default_vocabulary, encoder, text_batches

SEQUENCE = 4096
# Pieces of a batch: what one packing task holds.
BATCH_PIECES = 6_000
# Branches (other fillings tried after a step back) that one batch may open; beyond them
# its incumbent stands.
BRANCHES = 400
# Bins that the search may open over all branches: it bounds the time of a batch.
NODES = 20_000


# ---- bin completion over the lengths of one batch ---------------------------------------

class Pool:
    """A multiset of lengths: sorted distinct lengths, also as bits, and how many there are
    of each."""

    def __init__(self, lengths):
        values, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
        self.values = values.tolist()
        self.count = dict(zip(self.values, counts.tolist()))
        self.bits = sum(1 << v for v in self.values)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.count[x]
            self.bits ^= 1 << x
            self.values.pop(bisect_right(self.values, x) - 1)

    def give(self, x: int) -> None:
        if x in self.count:
            self.count[x] += 1
        else:
            self.count[x] = 1
            self.bits |= 1 << x
            insort(self.values, x)


def best_fit_decreasing(lengths, capacity: int) -> list[list[int]]:
    """Each length, from the largest, into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for x in sorted(lengths, reverse=True):
        k = bisect_right(room, (x, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(x)
        else:
            free, b = capacity, len(bins)
            bins.append([x])
        if free > x:
            insort(room, (free - x, b))
    return bins


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling a dominates filling b: b's pieces, dealt into groups, fit in place
    of a's pieces."""
    if sum(b) > sum(a):
        return False

    def fits(k: int, free: list[int]) -> bool:
        if k == len(b):
            return True
        tried = set()
        for i, f in enumerate(free):
            if f >= b[k] and f not in tried:
                tried.add(f)
                free[i] -= b[k]
                if fits(k + 1, free):
                    return True
                free[i] += b[k]
        return False
    return fits(0, list(a))


def _sums(values: list[int], pool: Pool, room: int) -> list[int]:
    """reach[k]: the sums up to ``room`` that the k smallest lengths can make, as bits."""
    mask = (1 << room + 1) - 1
    reach = [1]
    for v in values:
        r, left, step = reach[-1], pool.count[v], 1
        if left > 1:
            left = min(left, room // v)
        while left:
            step = min(step, left)
            r |= r << step * v & mask
            left -= step
            step *= 2
        reach.append(r)
    return reach


def _replaceable(chosen: tuple[int, ...], spare: int, slack: int) -> bool:
    """Whether a length of the bits ``spare`` fits in place of smaller ones of ``chosen``
    (largest first), alone or together, and of up to ``slack`` free places."""
    sums, below, k = 1, 0, len(chosen)
    while spare >> below:
        # sums of the chosen lengths up to ``below``, against lengths up to the next one
        top = chosen[k - 1] if k else None
        near, wide = sums, 0
        while wide < slack:
            by = min(wide + 1, slack - wide)
            near |= near << by
            wide += by
        span = spare >> below + 1 << below + 1
        if top is not None:
            span &= (1 << top + 1) - 1
        if near & span:
            return True
        if top is None:
            return False
        while k and chosen[k - 1] == top:
            sums |= sums << top
            k -= 1
        below = top
    return False


def fillings(pool: Pool, room: int, least: int = 0) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` that fills at least ``least`` of it, least waste
    first and made when it is asked for; the pool must be as it was at each turn.

    A filling is dominated exactly when a length that is left over fits in place of smaller
    ones of the filling (none, one or several) and of its waste."""
    values = pool.values[:bisect_right(pool.values, room)]
    reach = _sums(values, pool, room)
    bits = pool.bits & (1 << room + 1) - 1

    def grow(chosen: tuple[int, ...], spare: int, k: int, total: int, slack: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly ``total`` more from the k smallest lengths."""
        if not total:
            if not _replaceable(chosen, spare, slack):
                yield chosen
            return
        if not k:
            return
        free = spare & (1 << min(total, values[k - 1]) + 1) - 1
        if slack:  # not those that a larger one left out fits in place of
            near, wide = spare >> 1, 1
            while wide < slack:
                by = min(wide, slack - wide)
                near |= near >> by
                wide += by
            free &= ~near
        while free:
            v = free.bit_length() - 1
            free ^= 1 << v
            k = bisect_left(values, v)
            if not reach[k + 1] >> total & 1:
                return
            for n in range(min(pool.count[v], total // v), 0, -1):
                if reach[k] >> total - n * v & 1:
                    more = chosen + (v,) * n
                    over = spare if n < pool.count[v] else spare & ~(1 << v)
                    # lengths from v on that are not chosen stay out
                    if not _replaceable(more, over >> v << v, slack):
                        yield from grow(more, over, k, total - n * v, slack)

    # lengths within the waste must all be in
    must, k = 0, 0
    for total in range(room, max(least, 0) - 1, -1):
        while k < len(values) and values[k] <= room - total:
            must += values[k] * pool.count[values[k]]
            k += 1
        if must > total:
            return
        if reach[-1] >> total & 1:
            yield from grow((), bits, len(values), total, room - total)


def fewest(lengths, capacity: int) -> int:
    """A lower bound on the bins: for each a up to half of a bin, lengths over capacity - a are
    alone, those over a half share no bin with each other, and the others from a on fill what
    room the latter leave."""
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    before = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, capacity // 2, "right"))
    a = np.concatenate([[0], np.unique(x[:half])])
    alone = np.searchsorted(x, capacity - a, "right")
    least = np.searchsorted(x, a, "left")
    wide = alone - half  # bins of lengths over a half that may take more
    room = wide * capacity - (before[alone] - before[half])
    rest = before[half] - before[least]
    return int((len(x) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


def bin_completion(lengths, capacity: int, branches: int = BRANCHES, nodes: int = NODES) -> list[list[int]]:
    """Bins of lengths: as few as branch and bound finds within ``branches`` branches and
    ``nodes`` opened bins.

    A bin on the path keeps only how many of its fillings were tried; after a step back they are
    made anew from there on, so memory grows with the bins and not with their fillings.
    """
    lengths = [int(x) for x in lengths]
    best = best_fit_decreasing(lengths, capacity)
    total = sum(lengths)
    bound = fewest(lengths, capacity)
    if len(best) <= bound:
        return best
    pool = Pool(lengths)
    path: list[list[int]] = []
    # one frame per open bin: (largest piece, fillings tried, the filling in use)
    frames: list[list] = []
    waste, opened, steps = 0, 0, 0

    def completed() -> None:
        nonlocal best
        if len(path) < len(best):
            best = [list(b) for b in path]

    def open_bin() -> None:
        largest = pool.values[-1]
        pool.take(largest)
        frames.append([largest, 0, None])

    open_bin()
    while frames:
        frame = frames[-1]
        if frame[2] is not None:  # take the last choice back
            for x in frame[2]:
                pool.give(x)
            waste -= capacity - frame[0] - sum(frame[2])
            path.pop()
            frame[2] = None
        allowed = (len(best) - 1) * capacity - total  # waste of any packing with fewer bins
        choice, room = None, capacity - frame[0]
        if len(best) > bound and not (frame[1] and opened >= branches) and steps < nodes:
            # least waste first, none beyond what is allowed
            choice = next(islice(fillings(pool, room, room - (allowed - waste)), frame[1], None), None)
        if choice is None:
            pool.give(frame[0])
            frames.pop()
            continue
        more = room - sum(choice)
        opened += frame[1] > 0  # a branch: another filling after a step back
        steps += 1
        frame[1] += 1
        for x in choice:
            pool.take(x)
        waste += more
        path.append([frame[0], *choice])
        frame[2] = choice
        if pool.values:
            open_bin()
        else:
            completed()
    return best


# ---- Spark ------------------------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, batch long"
_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "batch"]


def _cutter(vocabulary: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts, dealt = (batch.column(k).to_pylist() for k in range(3))
            for i, j in text_batches(texts, 1 << 20):
                rows: list[tuple] = []
                for doc, b, body in zip(ids[i:j], dealt[i:j], enc.encode(texts[i:j])):
                    body += end
                    for p, at in enumerate(range(0, len(body), 4 * sequence)):
                        part = body[at:at + 4 * sequence]
                        rows.append((doc, p, p * sequence, len(part) // 4, zlib.crc32(part), b))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[2:]]], _PIECE_NAMES)
        enc.forget()
    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``sequence`` ids: doc_id, piece, start, length, ids_crc32, and the
    document's batch where ``docs`` has one."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("batch").cast("long"))
            .mapInArrow(tidied(_cutter(vocabulary or default_vocabulary(), sequence)), _PIECES))


def pack_batch(pieces: pa.Table, sequence: int = SEQUENCE, branches: int = BRANCHES) -> pa.Table:
    """The pieces of one batch with ``bin`` and ``offset``."""
    order = pc.sort_indices(pieces, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    pieces = pieces.take(order)
    lengths = pieces.column("length").to_pylist()
    # pieces of the same length are interchangeable: deal them out in order
    places: dict[int, list[tuple[int, int]]] = {}
    for b, members in enumerate(bin_completion(lengths, sequence, branches)):
        at = 0
        for x in members:
            places.setdefault(x, []).append((b, at))
            at += x
    turn = {x: iter(p) for x, p in places.items()}
    dealt = [next(turn[x]) for x in lengths]
    return (pieces.append_column("bin", pa.array([d[0] for d in dealt], pa.int64()))
            .append_column("offset", pa.array([d[1] for d in dealt], pa.int64())))


def file_order(docs: DataFrame, batch_docs: int) -> DataFrame:
    """``docs`` (a scan of written files) with a batch for every ``batch_docs`` documents in
    the order of the files."""
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (placed.groupBy("file").agg(F.count("*").alias("n"))
             .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return (placed.join(F.broadcast(files), "file")
            .select("doc_id", "text", F.floor((F.col("before") + F.col("row")) / batch_docs).alias("batch")))


def _packer_anew(columns: list[str], first: int, sequence: int, branches: int):
    def run(table: pa.Table) -> pa.Table:
        old = table.select(columns)
        new = pack_batch(table.drop_columns(["sequence_id", "offset"]), sequence, branches)
        if pc.max(new.column("bin")).as_py() + 1 >= pc.count_distinct(old.column("sequence_id")).as_py():
            return old
        # numbers that no batch before has
        number = pc.add(pc.multiply(pc.add(new.column("batch"), first), 1 << 32), new.column("bin"))
        return new.append_column("sequence_id", number).select(columns)
    return run


def repacked(packed: DataFrame, batches: int, sequence: int = SEQUENCE,
             batch_pieces: int = BATCH_PIECES, branches: int = BRANCHES) -> DataFrame:
    """``packed`` (of ``batches`` batches) with fewer sequences: those that are less filled
    than the mean are dealt and packed anew, round by round, until their number meets the
    bound of the total or stops falling."""
    columns, turn, before = packed.columns, 0, None
    packed = stored(packed, "packed")
    while True:
        bins = stored(packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("pieces")), "sequences")
        n, total = bins.agg(F.count("*"), F.sum("used")).first()
        if not n or n <= -(-total // sequence) or (before is not None and n >= before):
            return packed
        bad = bins.where(F.col("used") * n < total)
        n_bad, pieces = bad.agg(F.count("*"), F.sum("pieces")).first()
        if not n_bad:
            return packed
        bad, before, turn, first = sized(bad.select("sequence_id"), n_bad), n, turn + 1, batches
        dealt = max(1, -(-pieces // batch_pieces))
        batches += dealt

        anew = (packed.join(bad, "sequence_id").withColumn("batch", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(dealt)))
                .select(*columns, "batch").groupBy("batch").applyInArrow(_packer_anew(columns, first, sequence, branches), packed.schema))
        packed = stored(packed.join(bad, "sequence_id", "left_anti").select(*columns).unionByName(anew), "packed")


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE,
         batch_pieces: int = BATCH_PIECES, branches: int = BRANCHES, in_file_order: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A document has at most one piece that is not full, so batches are counted in documents.
    They are dealt by a hash, so that no batch grows with a source or a length, and badly
    filled sequences are packed anew across batches; with
    ``in_file_order`` they are runs of the order in which the files of ``docs`` hold them,
    and sequence numbers follow that order from batch to batch, so nothing moves across them.
    """
    bounded_batches(docs.sparkSession)
    if in_file_order:
        dealt = file_order(docs, batch_pieces)
    else:
        batches = max(1, -(-docs.count() // batch_pieces))
        # by the place of a row: repeated rows and null ids spread like all others
        dealt = (numbered(docs, "doc_id", "text")
                 .select("doc_id", "text", F.pmod(F.xxhash64("tag"), F.lit(batches)).alias("batch")))
    pieces = stored(token_pieces(dealt, vocabulary, sequence), "pieces")
    names = [n for n in _PIECE_NAMES if n != "batch"]

    def run(table: pa.Table) -> pa.Table:
        out = pack_batch(table, sequence, branches)
        # a batch has fewer bins than 2**32
        number = pc.add(pc.multiply(out.column("batch"), 1 << 32), out.column("bin"))
        return out.select(names).append_column("sequence_id", number).append_column("offset", out.column("offset"))

    packed = (pieces.where(F.col("length") < sequence).groupBy("batch")
              .applyInArrow(run, f"{_PIECES.rpartition(',')[0]}, sequence_id long, offset long"))
    if not in_file_order:
        packed = repacked(packed, batches, sequence, batch_pieces, branches)
    full = (pieces.where(F.col("length") == sequence)
            # negative numbers: sequences of their own
            .select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))
    return packed.unionByName(full)
