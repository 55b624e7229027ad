"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot holds one row per distinct text (its digest, size of its group, best row) dealt
into digest buckets, and one binary-fuse filter per bucket.  A new batch is grouped by
itself first (new-batch duplicates); the filters then screen its digests: what they refuse
is new for certain, what they pass joins the exact bucket and its bytes are compared with
the snapshot's text.

Texts are equal when identical after deleting space and the bytes 09-0D.  Of equal texts
the row with the most code points, then the smallest doc_id (null last) stays.

Results for odd input: a null text is an empty one; empty texts are equal to each other;
repeated rows (same doc_id too) are copies like others and exactly one stays; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import numbered, partitions, sized, stored

# Fixed value: the deleted characters.
BLANKS = " \t\n\x0b\x0c\r"
# Digests of one bucket (and keys of one filter).
BUCKET_KEYS = 50_000


# ---- binary fuse filter -----------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class BinaryFuseFilter:
    """A static three-way binary-fuse filter with 16-bit fingerprints over 64-bit keys.

    A key's three cells lie in three consecutive segments; the fingerprint is the xor of
    the cells.  Keys are peeled from cells that only one key uses, all such cells of a
    round at once, and cells are filled in reverse order.
    """

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int):
        h = _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        low = h & np.uint64(0xFFFFFFFF)
        at = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # first segment
        mask = np.uint64(segment - 1)
        second = _mix(h)
        places = np.stack([at * np.uint64(segment) + (low & mask),
                           (at + np.uint64(1)) * np.uint64(segment) + (second & mask),
                           (at + np.uint64(2)) * np.uint64(segment) + ((second >> np.uint64(32)) & mask)])
        return places.astype(np.int64), (_mix(second) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuseFilter":
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:  # unlucky sizes get more room
                segments += 1 + segments // 10
            order = cls._peel(keys, seed, segment, segments)
            if order is not None:
                return cls._fill(keys, seed, segment, segments, order)
        raise RuntimeError("no binary-fuse filter found")

    @classmethod
    def _peel(cls, keys, seed, segment, segments):
        places, _ = cls._places(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(places.ravel(), minlength=size)
        who = np.zeros(size, np.int64)  # xor of the key numbers of a cell
        for row in places:
            np.bitwise_xor.at(who, row, np.arange(len(keys)))
        alive = np.ones(len(keys), bool)
        rounds = []
        while True:
            cells = np.flatnonzero(count == 1)
            if not len(cells):
                break
            key, first = np.unique(who[cells], return_index=True)
            rounds.append((key, cells[first]))
            alive[key] = False
            for row in places[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(who, row, key)
        return None if alive.any() else rounds

    @classmethod
    def _fill(cls, keys, seed, segment, segments, rounds):
        places, prints = cls._places(keys, seed, segment, segments)
        cells = np.zeros((segments + 2) * segment, np.uint16)
        for key, own in reversed(rounds):
            # a key's own cell is still zero, so the xor of all three is that of the others
            cells[own] = prints[key] ^ cells[places[0, key]] ^ cells[places[1, key]] ^ cells[places[2, key]]
        return cls(seed, segment, segments, cells)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        return (self.cells[places[0]] ^ self.cells[places[1]] ^ self.cells[places[2]]) == prints


# ---- Spark ------------------------------------------------------------------------------

def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def digests(rows: DataFrame) -> DataFrame:
    """tag, doc_id, n (code points), digest, key (64 bits of it) of numbered rows."""
    return (_texts(rows)
            .select("tag", "doc_id", F.length("text").alias("n"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
            .withColumn("key", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("tag", F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _best() -> Column:
    # the smallest of these is the row that stays; a null doc_id comes after all others
    return F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag")))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: copies, best.  Map-side partial sums take hot digests apart."""
    return rows.groupBy("digest", "key").agg(F.count("*").alias("copies"), _best().alias("best"))


_FILTERS = "bucket int, seed int, segment int, segments int, cells binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = BinaryFuseFilter.build(pdf["key"].to_numpy(np.int64).astype(np.uint64))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment],
                         "segments": [f.segments], "cells": [f.cells.tobytes()]})


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(filters):
        f = filters.iloc[0]
        fuse = BinaryFuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["cells"], np.uint16))
        maybe = fuse.contains(new["key"].to_numpy(np.int64).astype(np.uint64))
    else:
        maybe = np.zeros(len(new), bool)
    return pd.DataFrame({"digest": new["digest"], "maybe": maybe})


class Snapshot:
    """An immutable set of groups and its filters, both written to the shared folder."""

    def __init__(self, groups: DataFrame, buckets: int):
        self.buckets = buckets
        self.groups = stored(groups.withColumn("bucket", bucket(buckets)), "snapshot-groups")
        self.filters = stored(self.groups.select("bucket", "key").groupBy("bucket").applyInPandas(_build, _FILTERS),
                              "snapshot-filters")


def bucket(buckets: int) -> Column:
    return F.pmod(F.col("key"), F.lit(buckets)).cast("int")


def screen(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of ``new`` with ``maybe``: whether the snapshot may hold them."""
    keyed = new.select("digest", "key", bucket(snapshot.buckets).alias("bucket"))
    return (keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket"))
            .applyInPandas(_screen, "digest binary, maybe boolean"))


def same_bytes(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Digests of ``pairs`` (digest, old_tag, new_tag) whose normalised texts are equal byte
    by byte.  Only the texts of the pairs are fetched."""
    tags = pairs.select("digest", F.explode(F.array("old_tag", "new_tag")).alias("tag"))
    texts = (_texts(rows).join(sized(tags, 2 * n), "tag").select("digest", normalised(F.col("text")).alias("norm")))
    return texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a = b").select("digest")


def exact_dedup(docs: DataFrame, first_batch: Column | None = None) -> DataFrame:
    """Dedup ``docs`` (doc_id, text) as two batches: rows where ``first_batch`` holds make the
    snapshot, the others come in against it.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and tag.
    """
    return dedup_rows(numbered(docs, "doc_id", "text"), first_batch)


def dedup_rows(texts: DataFrame, first_batch: Column | None = None) -> DataFrame:
    """``exact_dedup`` of rows that carry their number (tag)."""
    first_batch = first_batch if first_batch is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = stored(digests(texts).withColumn("old", F.coalesce(first_batch, F.lit(True))), "digests")
    old_groups = grouped(rows.where("old"))
    new = stored(grouped(rows.where("NOT old")), "new-groups")
    # a bucket holds a filter and the digests that are screened against it: the larger side counts
    larger = max(rows.where("old").count(), new.count())
    snapshot = Snapshot(old_groups, max(partitions(texts.sparkSession), -(-larger // BUCKET_KEYS)))

    positive = screen(new, snapshot).where("maybe").select("digest")
    old = snapshot.groups.select("digest", F.col("copies").alias("old_copies"), F.col("best").alias("old_best"))
    met = stored(new.join(positive, "digest").join(old, "digest")
                 .select("digest", "old_copies", "old_best", F.col("best.tag").alias("new_tag"),
                         F.col("old_best.tag").alias("old_tag")), "met")
    equal = same_bytes(texts, met.select("digest", "old_tag", "new_tag"), met.count())
    met = met.join(equal, "digest").select("digest", "old_copies", "old_best")

    # groups of both: those of the snapshot that nothing met, and those of the batch
    merged = (new.join(met, "digest", "left")
              .select("digest", (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"),
                      F.least("best", "old_best").alias("best")))
    alone = (old.join(met.select("digest"), "digest", "left_anti")
             .select("digest", F.col("old_copies").alias("group_size"), F.col("old_best").alias("best")))
    groups = stored(merged.unionByName(alone), "groups")
    # of texts with one digest but other bytes (never seen) each batch keeps its own group
    return (rows.join(groups, "digest")
            .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    (F.col("tag") == F.col("best.tag")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "tag"))
