"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of at
least 0.8.  Texts with the same set collapse to one representative first, so copies cost
nothing further.  Then:

1. Buckets.  128 MinHash values make 32 bands of four; equal bands meet in a bucket (a link
   of similarity 0.8 is in no bucket with a probability of 5e-8).
2. Clusters.  The members of a bucket are compared value by value, 32 at a time; a pair is
   dropped when the posterior probability of reaching the threshold falls below
   ``TOLERANCE``.  What is left joins members into clusters.  A bucket of more than
   ``BUCKET_MEMBERS`` is joined as a whole: clusters only grow by that, and no link is lost.
3. Cells.  All pairs of a cluster are pruned in the same way and the rest verified exactly
   on the sets.  Large clusters are cut into blocks, and each pair of blocks is a cell, so a
   cell is bounded however large the cluster is; only counts and one root per
   representative leave a cell, never the pairs.

Classes are the connected components of the links.

Results for odd input: a null text is an empty one; texts without words have no links and
are classes of their own; texts of fewer than five words have one shingle of all their
words; a null doc_id takes part and comes after all others as class id; repeated rows are
copies of each other; an empty table gives an empty result; other columns are not read.
``docs`` must be a table scan (rows are numbered by their place in it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, components, numbered, partitions, sized, stored, tidied
from gymlake.llm.words import shingles, slices, text_bytes, word_hashes

WORDS = 5
THRESHOLD = 0.8
HASHES, BAND = 128, 4
STEP = 32            # values compared before each decision
TOLERANCE = 1e-6     # of the posterior probability
BUCKET_MEMBERS = 512
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 400_000


# ---- MinHash and pruning ----------------------------------------------------------------

def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return (rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32))


_A, _B = _hash_family()


def signature(s: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits of a set of 64-bit shingles."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        part = h[i:i + 1024, None] * _A + _B
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=0), out=low)
    # the smallest values share their high bits: mix before taking 16 of them
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return (low >> np.uint32(16)).astype("<u2")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For 32, 64, ... values compared: the fewest matches with which the posterior
    probability (uniform prior) of a similarity >= threshold is at least ``tolerance``."""
    x = (np.arange(20_000) + 0.5) / 20_000
    lx, ly, above = np.log(x), np.log1p(-x), x >= threshold
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            p = m * lx + (n - m) * ly
            p = np.exp(p - p.max())
            if p[above].sum() >= tolerance * p.sum():
                out[n] = m
                break
    return out


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that may still reach the threshold."""
    same = np.zeros(len(a), np.int32)
    for n, m in least.items():
        same += (sig[a, n - STEP:n] == sig[b, n - STEP:n]).sum(axis=1, dtype=np.int32)
        keep = same >= m
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs."""
    if len(a) < 300:
        out = np.empty(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[k] = np.count_nonzero(y[at] == x) if len(y) else 0
        return out
    rows, ra, rb = _positions(a, b)
    sizes = [len(sets[i]) for i in rows]
    values, number, often = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    shared = often[number] > 1
    owner, number = owner[shared], (np.cumsum(often > 1) - 1)[number[shared]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    width = 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        s, e = np.searchsorted(number, (low, low + width))
        m = np.zeros((len(rows), width), np.float32)
        m[owner[s:e], number[s:e] - low] = 1
        total += m @ m.T
    return total[ra, rb].astype(np.int64)


def _positions(a: np.ndarray, b: np.ndarray):
    rows, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    return rows.tolist(), back[:len(a)], back[len(a):]


def linked_pairs(sig: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float,
                 least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets have a similarity >= threshold."""
    size = np.array([len(s) for s in sets])
    # sets of sizes too far apart cannot reach it
    near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    a, b = pruned(sig, a[near], b[near], least)
    if not len(a):
        return a, b
    common = common_counts(sets, a, b)
    keep = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[keep], b[keep]


# ---- Spark ------------------------------------------------------------------------------

def _sets(column, words: int) -> list[np.ndarray]:
    data, offs = text_bytes(column)
    out: list[np.ndarray] = []
    for i, j in slices(offs):
        out += shingles(*word_hashes(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]), words)
    return out


def _signer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            for i, j in slices(offs):  # a slice's sets go before the next ones come
                sets = shingles(*word_hashes(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]), words)
                bands = np.stack([signature(s) for s in sets]).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))],
                    ["tag", "doc_id", "n", "digest", "bands"])
    return run


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of batches sorted by their first ``keys`` columns, one table per key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    """Band columns back to a matrix of MinHash values."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
    return flat.view("<u2").reshape(-1, HASHES)


def _joiner(least: dict[int, int]):
    """Of sorted (bucket, rep, bands): edges from each rep to its root in the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for table in runs(batches, 1):
            rep = table.column(1).to_numpy()
            sig = _matrix(table.column(2))
            a, b = pruned(sig, *np.triu_indices(len(rep), 1), least)
            root = roots(len(rep), a, b)
            moved = np.flatnonzero(root != np.arange(len(rep)))
            out_a.append(rep[moved])
            out_b.append(rep[root[moved]])
            if len(out_a) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (out_a, out_b)], ["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (out_a, out_b)], ["a", "b"])
    return run


def _verifier(words: int, threshold: float, least: dict[int, int]):
    """Of sorted (label, i, j, block, rep, copies, bands, text) cells: rep, links, root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = [[], [], []]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in rows], ["rep", "links", "root"])
        for table in runs(batches, 3):
            i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            block, rep, copies = (table.column(k).to_numpy() for k in (3, 4, 5))
            sets = _sets(table.column(7), words)
            if i == j:
                a, b = np.triu_indices(len(rep), 1)
            else:
                one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
                a, b = np.repeat(one, len(two)), np.tile(two, len(one))
            a, b = linked_pairs(_matrix(table.column(6)), sets, a, b, threshold, least)
            links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            root = roots(len(rep), a, b)
            for held, values in zip(rows, (rep, links.astype(np.int64), rep[root])):
                held.append(values)
            if len(rows[0]) >= 1000:
                yield batch()
                rows = [[], [], []]
        if rows[0]:
            yield batch()
    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD,
                    bucket_members: int = BUCKET_MEMBERS, block_members: int = BLOCK_MEMBERS,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id of its
    class), n_links (other rows it is linked to), kept (one row per class), tag."""
    return near_rows(numbered(docs, "doc_id", "text"), words, threshold, bucket_members, block_members, block_shingles)


def near_rows(texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bucket_members: int = BUCKET_MEMBERS,
              block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``near_duplicates`` of rows that carry their number (tag)."""
    spark = texts.sparkSession
    bounded_batches(spark)
    least = least_matches(threshold, TOLERANCE)
    tagged = texts.select("tag", F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    signed = stored(tagged.mapInArrow(tidied(_signer(words)), "tag long, doc_id long, n long, digest binary, bands array<long>"), "signed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")
    reps = stored(signed.where("n > 0").groupBy("digest").agg(first, F.count("*").alias("copies"), F.min("n").alias("n"))
                  .select("digest", "first", "copies", "n", F.col("first.tag").alias("rep")), "reps")
    n_reps = reps.count()
    bands = signed.select(F.col("tag").alias("rep"), "bands").join(sized(reps.select("rep"), n_reps), "rep", "left_semi")

    # buckets of at least two representatives
    banded = bands.select("rep", F.posexplode("bands").alias("band", "key"))
    full = (banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).where("size > 1"))
    member = stored(banded.join(full, ["band", "key"]), "buckets")
    large = member.where(F.col("size") > bucket_members).select(F.col("rep").alias("a"), F.col("centre").alias("b")).where("a != b")
    # equal buckets of several bands are one; a bucket here is bounded by bucket_members
    small = (member.where(F.col("size") <= bucket_members).groupBy("band", "key")
             .agg(F.sort_array(F.collect_list("rep")).alias("reps")).groupBy("reps").agg(F.lit(1).alias("one"))
             .select(F.xxhash64("reps").alias("bucket"), F.explode_outer("reps").alias("rep")))
    n = partitions(spark)
    compared = (small.join(bands, "rep").select("bucket", "rep", "bands")
                .repartition(n, "bucket").sortWithinPartitions("bucket")
                .mapInArrow(tidied(_joiner(least)), "a long, b long"))
    clusters = components(large.unionByName(compared), "clusters")

    # cells of the clusters
    in_cluster = stored(clusters.join(reps.select("rep", "copies", "n"), clusters.node == F.col("rep"))
                        .select("rep", "label", "copies", "n"), "members")
    cut = (in_cluster.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
           .select("label", F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("s") / block_shingles)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    celled = (in_cluster.join(cut, "label").withColumn("block", block)
              .withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies"))
    texts = (tagged.select(F.col("tag").alias("rep"), "text")
             .join(sized(in_cluster.select("rep"), in_cluster.count()), "rep", "left_semi")
             .join(bands.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).drop("r"))
    verified = stored(celled.join(texts, "rep")
                      .select("label", "i", "j", "block", "rep", "copies", "bands", "text")
                      .repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j")
                      .mapInArrow(tidied(_verifier(words, threshold, least)), "rep long, links long, root long"), "verified")

    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(verified.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "classes")
    labelled = (reps.join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
                .select("digest", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                        F.coalesce("label", "rep").alias("class")))
    heads = labelled.groupBy("class").agg(F.min("first").alias("head"))
    known = stored(labelled.join(heads, "class").select("digest", "copies", "links", "head"), "classes")
    out = signed.select("tag", "doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(known, "digest", "left")
    return out.select("doc_id", F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(F.col("n") > 0, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"),
                      ((F.col("n") == 0) | (F.col("tag") == F.col("head.tag"))).alias("kept"), "tag")
