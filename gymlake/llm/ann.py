"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index: a vector less the centre (mean of a bounded sample) is scaled to length one and
rotated; the code keeps one sign bit per component, packed, and two scalars: the length and
the inner product of the code with the rotated vector.  Search: codes estimate the inner
product with a query, the second scalar bounds the error, and only vectors whose upper
bound reaches the k-th best lower bound are reranked with their own components in double
precision.

Every vector is indexed.  Queries meet vectors in cells (a group of vectors with a block of
queries, both of bounded size); each cell gives the k best of each query, and a window over
these gives the result, so the work is queries x vectors in cells that never grow.

Results for odd input: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without a vec_id, take no part; repeated rows of a vec_id count once (the
smallest vector, in array order) and are the query's own; vectors of another length than the
query's are not compared; equal scores go to the smaller vec_id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import stored

GROUP_ROWS = 8_192     # vectors of a cell
BLOCK_QUERIES = 1_024  # queries of a cell
SAMPLE_ROWS = 5_000    # vectors that the centre is taken from, about
# Standard deviations of the estimate that the bounds allow for.
SPREAD = 4.0


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for the same ``dim``."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths, inner products of code and rotated unit vector)."""
    rest = vectors - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = rest / np.where(length > 0, length, 1)[:, None]
    turned = unit @ rotation(vectors.shape[1])
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, agreement, 1.0)


def bounds(bits, length, agreement, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products, one row per query."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim)).astype(np.float32)
    scale = (length / (agreement * np.sqrt(dim))).astype(np.float32)
    estimate = (turned @ signs.T) * scale + (queries @ centre).astype(np.float32)[:, None]
    wide = length * np.sqrt(np.maximum(1 - agreement ** 2, 0)) / agreement * SPREAD / np.sqrt(max(dim - 1, 1))
    # and a little for single precision
    error = (np.sqrt((queries ** 2).sum(axis=1))[:, None] * (wide + 1e-5 * (length + 1))).astype(np.float32) + np.float32(1e-6)
    return estimate - error, estimate + error


def screen(found: np.ndarray, single: np.ndarray, size: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Which of the vectors marked in ``found`` (queries x vectors) may be among the k best of
    their query: inner products in single precision, less their rounding, decide."""
    length = np.sqrt((queries ** 2).sum(axis=1)).astype(np.float32)
    score = queries.astype(np.float32) @ single.T
    error = length[:, None] * (np.float32(max(1e-5, queries.shape[1] * 2.0 ** -23)) * (size + 1)) + np.float32(1e-6)
    low = np.where(found, score - error, -np.inf)
    low[np.isnan(low)] = -np.inf
    cut = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
    # a product that is not a number stays
    return found & ~(score + error < cut[:, None])


def search_cell(ids: np.ndarray, vectors: np.ndarray, coded, centre, query_ids, queries, k: int):
    """(query_id, vec_id, score) arrays: the k best of each query in this cell."""
    out = []
    single, size = vectors.astype(np.float32), np.sqrt((vectors ** 2).sum(axis=1)).astype(np.float32)
    order = np.argsort(ids)
    place = order[np.minimum(np.searchsorted(ids, query_ids, sorter=order), len(ids) - 1)]
    for s in range(0, len(queries), 256):
        low, high = bounds(*coded, queries[s:s + 256], centre)
        own = np.flatnonzero(ids[place[s:s + 256]] == query_ids[s:s + 256])
        at = own, place[s:s + 256][own]
        low[at] = high[at] = -np.inf
        cut = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
        near = high >= cut[:, None]
        near[at] = False
        # candidates of the whole block, scored in one product before single rows are
        some = np.flatnonzero(near.any(axis=0))
        best_of = screen(near[:, some], single[some], size[some], queries[s:s + 256], k)
        for r in range(len(low)):
            near = some[best_of[r]]
            # row by row sums, so that equal vectors have equal scores
            score = (vectors[near] * queries[s + r]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), query_ids[s + r]), ids[near][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vector: one row per vec_id that takes part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
            .where("vec_id IS NOT NULL AND vector IS NOT NULL").where(finite)
            .where(F.exists("vector", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("vector").alias("vector"))
            .withColumn("dim", F.size("vector")))


_INDEX = "vec_id long, dim int, vector array<double>, bits binary, length double, agreement double"


def build_index(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """One coded row per point."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                vectors = np.stack(part["vector"].to_numpy())
                bits, length, agreement = encode(vectors, centres.get(dim, np.zeros(dim)))
                yield pd.DataFrame({"vec_id": part["vec_id"], "dim": part["dim"], "vector": part["vector"],
                                    "bits": [b.tobytes() for b in bits], "length": length, "agreement": agreement})
    return points.mapInPandas(run, _INDEX)


def centres_of(points: DataFrame, n: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Mean vector of a bounded sample, for each vector length in it."""
    limit = int(min(1.0, sample_rows / max(n, 1)) * 2**31)
    picked = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < limit)
    sums = (picked.select("dim", F.posexplode("vector").alias("place", "x")).groupBy("dim", "place")
            .agg(F.avg("x").alias("x")).groupBy("dim")
            .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("mean")).collect())
    return {r["dim"]: np.array([p["x"] for p in r["mean"]]) for r in sums}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, group_rows: int = GROUP_ROWS,
            block_queries: int = BLOCK_QUERIES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector where ``is_query`` holds,
    among all other vectors."""
    points = stored(usable(vectors), "points")
    n = points.count()
    centres = centres_of(points, n, sample_rows)
    index = stored(build_index(points, centres), "codes")
    queries = index.where(is_query)
    groups = max(1, -(-n // group_rows))
    blocks = max(1, -(-queries.count() // block_queries))

    def deal(parts: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    held = index.withColumn("g", deal(groups, 1)).withColumn("b", every(blocks))
    asked = (queries.select(F.col("vec_id").alias("query_id"), "dim", F.col("vector").alias("query"),
                            deal(blocks, 2).alias("b")).withColumn("g", every(groups)))

    def cell(key, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(key[0])
        bits = np.frombuffer(b"".join(have["bits"]), np.uint8).reshape(len(have), -1)
        coded = (bits, have["length"].to_numpy(), have["agreement"].to_numpy())
        found = search_cell(have["vec_id"].to_numpy(), np.stack(have["vector"].to_numpy()), coded,
                            centres.get(dim, np.zeros(dim)), ask["query_id"].to_numpy(),
                            np.stack(ask["query"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    best = (held.groupBy("dim", "g", "b").cogroup(asked.groupBy("dim", "g", "b"))
            .applyInPandas(cell, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
