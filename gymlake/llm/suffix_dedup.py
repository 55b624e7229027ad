"""Suffix-array dedup: remove every byte covered by a 200-byte string that occurs elsewhere.

The collection is built column by column: each round inserts one symbol of every document
and updates the collection's Burrows-Wheeler transform (the order of the suffixes and the
symbols before them) and the common prefixes of neighbours.  A suffix of the texts matters
for its first 200 bytes only, so the texts enter the collection as bounded pieces:

1. Anchors.  Of the ``K``-byte strings in a 200-byte window the one with the smallest hash is
   its anchor (the leftmost of equal ones).  Equal windows have equal anchors at equal places,
   so windows can only be equal where anchors are.  A run of windows with one anchor is a
   context: the at most 368 bytes that these windows cover.
2. Screening.  An anchor that occurs once is in no repeat.  Where all contexts of an anchor
   are the same, all their windows are repeats.  What is left are anchors with several
   distinct contexts; each distinct context is one document of the collection, whatever the
   number of its copies.
3. Construction.  The contexts of an anchor are aligned on it, so that equal windows start in
   the same column, and one round per column, from the right, sorts the suffixes that begin
   there from the order of the round before.  Neighbours with a common prefix of 200 or more
   are repeats.  Documents come through Spark's sorted files in one sequential pass, and a
   collection is bounded by ``COLLECTION`` contexts and the largest anchor group.
4. An anchor with more than ``GROUP_CONTEXTS`` distinct contexts is not collected: its windows
   are counted by digest in a distributed aggregate instead, which is exact as well.

Results for odd input: a null text is an empty one; texts shorter than 200 bytes lose
nothing; repeated rows are repeats of each other wherever they are long enough; a null doc_id
is kept; an empty table gives an empty result; other columns are not read.  ``docs`` must be
a table scan (rows are numbered by their place in it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, numbered, partitions, sized, stored, tidied
from gymlake.llm.words import mix, prefix_hash, slices, text_bytes

LENGTH = 200
K = 40
COLLECTION = 8_000
PART = 1 << 22  # bytes of a long text that are looked at in one go
GROUP_CONTEXTS = 50_000


# ---- anchors ----------------------------------------------------------------------------

def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:len(v)] = v
    rows = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def contexts(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """Arrays (text, place, left, right, anchor, digest): every run of windows with one
    anchor covers the bytes [place - left, place + right) of its text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    p, down = prefix_hash(data)
    n = len(data)
    kmer = mix((p[k:] - p[:n - k + 1]) * down[:n - k + 1])
    # order by 40 bits of the hash, then by place
    place_bits = np.uint64(24)
    if n >= 1 << 24:
        raise ValueError("a slice is limited to 16 MB")
    v = (kmer >> place_bits << place_bits) | np.arange(len(kmer), dtype=np.uint64)
    at = (sliding_min(v, length - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.arange(len(at))
    text = np.searchsorted(offs, first, "right") - 1
    ok = first + length <= offs[text + 1]
    first, text, at = first[ok], text[ok], at[ok]
    if not len(first):
        return none, none, none, none, none, none
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(first)) - 1
    low, high, at, text = first[start], first[stop] + length, at[start], text[start]
    whole = (p[high] - p[low]) * down[low]
    digest = mix(mix(whole) ^ mix((at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - at).astype(np.uint64)))
    return text, at - offs[text], at - low, high - at, kmer[at].view(np.int64), digest.view(np.int64)


# ---- column-wise construction -----------------------------------------------------------

class Collection:
    """Suffix order and common prefixes of aligned documents, built column by column.

    ``body`` holds the documents' bytes, one row each; document i has the columns
    [begin[i], end[i]).  ``group`` (non-decreasing) says which documents belong together.
    """

    def __init__(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.body, self.begin, self.end, self.group = body, begin, end, group
        self.order = np.zeros(0, np.int64)   # documents by their suffix from the last column on
        self.common = np.zeros(0, np.int32)  # common prefix with the one before
        self.transform = np.zeros(0, np.uint8)  # symbols that were put before these suffixes

    def round(self, column: int) -> None:
        """Insert the symbols of ``column`` (the next to the left)."""
        begins = np.flatnonzero(self.end == column + 1)
        order, common = self.order, self.common
        if len(begins):  # documents that end here: an empty suffix is the first of its group
            at = np.searchsorted(self.group[order], self.group[begins], "left")
            order, common = np.insert(order, at, begins), np.insert(common, at, 0)
            # what follows a new first one had nothing in common with the one before
            heads = np.ones(len(order), bool)
            heads[1:] = self.group[order[1:]] != self.group[order[:-1]]
            common[heads] = 0
        live = self.begin[order] <= column
        symbol = self.body[order, column].astype(np.int64)
        key = self.group[order] * 256 + symbol
        key[~live] = np.iinfo(np.int64).max
        turn = np.argsort(key, kind="stable")[:int(live.sum())]
        same = np.zeros(len(turn), bool)
        same[1:] = key[turn[1:]] == key[turn[:-1]]
        longer = np.zeros(len(turn), np.int32)
        pair = np.flatnonzero(same)
        if len(pair):
            a, b = turn[pair - 1] + 1, turn[pair] + 1
            bounds = np.empty(2 * len(pair), np.int64)
            bounds[::2], bounds[1::2] = a, b
            low = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            longer[pair] = low + 1
        self.order, self.common, self.transform = order[turn], longer, symbol[turn].astype(np.uint8)

    def repeats(self, length: int) -> np.ndarray:
        """Documents whose suffix from the last column on shares ``length`` symbols."""
        hit = self.common >= length
        hit[:-1] |= self.common[1:] >= length
        return self.order[hit]


def repeated_columns(body, begin, end, group, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) column where a repeated window of each document begins; the
    smallest is larger where there is none."""
    built = Collection(body, begin, end, group)
    low = np.full(len(group), body.shape[1], np.int64)
    high = np.full(len(group), -1, np.int64)
    for column in range(body.shape[1] - 1, -1, -1):
        built.round(column)
        found = built.repeats(length)
        low[found] = column
        high[found] = np.maximum(high[found], column)
    return low, high


# ---- Spark ------------------------------------------------------------------------------

_ANCHORS = "tag long, place int, left int, right int, anchor long, digest long"
_NAMES = ["tag", "place", "left", "right", "anchor", "digest"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy()
            data, offs = text_bytes(batch.column(1))
            for i, j in slices(offs):
                part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                if not len(part):  # null and empty texts only
                    continue
                # a long text goes in parts that share length - 1 bytes, so each window is in one
                for s in range(0, len(part), PART if j == i + 1 else len(part)):
                    piece = part[s:s + PART + length - 1] if j == i + 1 else part
                    text, place, *cols = contexts(piece, np.array([0, len(piece)]) if j == i + 1 else o, length, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((tags[i:j][text], place + s, *cols), _TYPES)], _NAMES)
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, list of contexts): anchor, digest, copies, left, and the context's bytes."""
    for batch in batches:
        data, offs = text_bytes(batch.column(0))
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        place, left, right = (flat.field(n).to_numpy().astype(np.int64) for n in ("place", "left", "right"))
        low, high = offs[owner] + place - left, offs[owner] + place + right
        yield pa.RecordBatch.from_arrays(
            [flat.field("anchor"), flat.field("digest"), flat.field("copies"), flat.field("left"),
             pa.array([data[a:b].tobytes() for a, b in zip(low, high)], pa.binary())],
            ["anchor", "digest", "copies", "left", "body"])


def _builder(length: int, k: int):
    """Of contexts sorted by anchor: anchor, digest, from, to (removed bytes, from the anchor)."""
    width = 2 * length - k

    def build(table: pa.Table) -> pa.RecordBatch:
        anchor, digest, copies = (table.column(c).to_numpy() for c in range(3))
        left = table.column(3).to_numpy().astype(np.int64)
        data, offs = text_bytes(table.column(4))
        size = np.diff(offs)
        begin = (length - k) - left
        body = np.zeros((len(anchor), width + k), np.uint8)
        flat = np.arange(len(data)) - np.repeat(offs[:-1], size) + np.repeat(begin, size)
        body[np.repeat(np.arange(len(anchor)), size), flat] = data
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        low, high = repeated_columns(body, begin, begin + size, group, length)
        twice = copies > 1  # every window of a context with copies is repeated
        low[twice], high[twice] = begin[twice], (begin + size)[twice] - length
        hit = low <= high
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[hit]), pa.array(digest[hit]), pa.array(low[hit] - (length - k), pa.int32()),
             pa.array(high[hit] + length - (length - k), pa.int32())], ["anchor", "digest", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for s in range(0, batch.num_rows, COLLECTION):
                held.append(batch.slice(s, COLLECTION))
                rows += held[-1].num_rows
                if rows < COLLECTION:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table.column(0).to_numpy()
                change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                if len(change):  # the last anchor may go on
                    yield build(table.slice(0, change[-1]))
                    table = table.slice(change[-1])
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield build(pa.Table.from_batches(held))
    return run


def _windows(length: int, k: int):
    """Of contexts: anchor, digest, copies, column and 128-bit hash of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(3).to_numpy().astype(np.int64)
            data, offs = text_bytes(batch.column(4))
            many = np.diff(offs) - length + 1
            p, down = prefix_hash(data)
            q, down_q = prefix_hash((mix(data.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8))
            owner = np.repeat(np.arange(len(many)), many)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            at = offs[owner] + turn
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), batch.column(2).take(pa.array(owner)),
                 pa.array(turn - left[owner], pa.int32()),
                 pa.array(mix((p[at + length] - p[at]) * down[at]).view(np.int64)),
                 pa.array(mix((q[at + length] - q[at]) * down_q[at]).view(np.int64))],
                ["anchor", "digest", "copies", "column", "w1", "w2"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (tag, list of spans): tag, and the starts and ends of the merged spans."""
    for batch in batches:
        lists = batch.column(1)
        edges = lists.offsets.to_numpy()
        flat = lists.flatten()
        a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        base = edges[0]
        starts, ends = [], []
        for s, e in zip(edges[:-1] - base, edges[1:] - base):
            order = np.argsort(a[s:e], kind="stable")
            low, high = a[s:e][order], np.maximum.accumulate(b[s:e][order])
            first = np.ones(len(low), bool)
            first[1:] = low[1:] > high[:-1]
            starts.append(low[first])
            ends.append(high[np.append(np.flatnonzero(first)[1:], len(low)) - 1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())),
                                          pa.array(ends, pa.list_(pa.int32()))], ["tag", "starts", "ends"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        rows = []
        for t, (starts, ends) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            text = data[offs[t]:offs[t + 1]]
            kept, at = hashlib.sha256(), 0
            for s, e in zip(starts or (), ends or ()):
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((len(text), sum(ends or ()) - sum(starts or ()), len(starts or ()), kept.hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, length: int = LENGTH, k: int = K, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """tag, starts, ends: the byte spans to remove from each numbered row that has some."""
    n = partitions(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    texts = rows.select("tag", F.col("text").cast("string").alias("text"))
    anchors = stored(texts.mapInArrow(tidied(_anchors(length, k)), _ANCHORS), "anchors")

    # screening: anchors that occur again, and whether their contexts differ
    again = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
                   .where("n > 1").select("anchor", (F.col("d0") != F.col("d1")).alias("mixed")), "repeated-anchors")
    met = stored(anchors.join(sized(again, again.count()), "anchor"), "met-anchors")
    whole = met.where("NOT mixed").select("tag", (F.col("place") - F.col("left")).alias("a"), (F.col("place") + F.col("right")).alias("b"))

    # documents of the collections: distinct contexts
    distinct = stored(met.where("mixed").groupBy("anchor", "digest")
                      .agg(F.count("*").alias("copies"), F.min(F.struct("tag", "place", "left", "right")).alias("at")), "contexts")
    by_text = (distinct.groupBy(F.col("at.tag").alias("tag"))  # at most one list entry per anchor of the text
               .agg(F.collect_list(F.struct("anchor", "digest", "copies", "at.place", "at.left", "at.right")).alias("list")))
    bodies = (texts.join(by_text, "tag").select("text", "list")
              .mapInArrow(_cut, "anchor long, digest long, copies long, left int, body binary"))
    large = stored(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group_contexts).select("anchor"), "large")
    n_large = large.count()
    if n_large:
        bodies = stored(bodies, "bodies")
    small_bodies = bodies.join(sized(large, n_large), "anchor", "left_anti") if n_large else bodies
    found = (small_bodies.repartition(n, "anchor").sortWithinPartitions("anchor", "digest")
             .mapInArrow(tidied(_builder(length, k)), "anchor long, digest long, from int, to int"))
    if n_large:
        windows = stored(bodies.join(sized(large, n_large), "anchor", "left_semi").select("anchor", "digest", "copies", "left", "body")
                         .mapInArrow(_windows(length, k), "anchor long, digest long, copies long, column int, w1 long, w2 long"), "windows")
        same = ["anchor", "column", "w1", "w2"]
        twice = windows.groupBy(same).agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
        found = found.unionByName(windows.join(twice, same).groupBy("anchor", "digest")
                                  .agg(F.min("column").alias("from"), (F.max("column") + length).alias("to")))
    found = stored(found, "found")
    partly = (met.where("mixed").join(sized(found, found.count()), ["anchor", "digest"])
              .select("tag", (F.col("place") + F.col("from")).alias("a"), (F.col("place") + F.col("to")).alias("b")))
    return (whole.unionByName(partly).groupBy("tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
            .mapInArrow(_merge, "tag long, starts array<int>, ends array<int>"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    rows = numbered(docs, "doc_id", "text")
    spans = stored(repeated_spans(rows, length, k, group_contexts), "spans")
    total = spans.agg(F.sum(F.size("starts"))).first()[0] or 0
    texts = rows.select("tag", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (texts.join(sized(spans, total), "tag", "left").select("doc_id", "text", "starts", "ends")
            .mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
