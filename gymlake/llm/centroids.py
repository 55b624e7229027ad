"""Centroid clustering in integers, with the threshold algorithm for the nearest centroid.

Vectors become integers ``floor(scale * x)``, so every sum and distance is exact and results do
not depend on the order of rows, batches or tasks.  The nearest centroid is found by the
threshold algorithm: per dimension the centroids are sorted by their value; from the vector's own
value each dimension's list is walked outward, nearest value first.  A centroid seen for the
first time gets its exact squared distance.  The squared gaps at the frontiers of all dimensions
sum to a lower bound for every centroid not yet seen; the walk stops when that sum strictly
exceeds the best exact distance (strictly, so that a tie with a smaller number is still found).

A round is one pass over the stored integer vectors: tasks assign their rows and give one row of
component sums per centroid, which Spark adds up; the driver holds only the model (k centroids).

Results for odd input: vectors that are null, of another length, or with a null or non-finite
component take no part; a null vec_id takes part (it counts as an empty string in the order of
the first centroids); repeated rows are vectors of their own; with fewer than k vectors each is a
centroid; an empty table gives an empty result; other columns are not read.  Components beyond
+-2**19 (integers beyond +-2**27) would overflow 64-bit distances: they raise a ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import stored

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
# Integers up to this size keep 64 squared differences within a long.
LARGEST = 1 << 27
# Vectors that one numpy step walks together.
STEP = 1024


class CentroidLists:
    """Per dimension the centroids in ascending order of their value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T.copy()  # dims x k
        self.values = np.take_along_axis(self.centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the
        smaller number."""
        best, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i in range(0, len(x), STEP):
            best[i:i + STEP], distance[i:i + STEP] = self._walk(x[i:i + STEP])
        return best, distance

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        far = np.iinfo(np.int64).max
        best, distance = np.full(len(x), k), np.full(len(x), far)
        row = np.arange(len(x))  # rows still walking
        dim = np.arange(dims)
        # the next list places above and below the vector's own value
        above = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        below = above - 1
        unseen = np.ones((len(x), k), bool)
        for _ in range(k):  # each list gives one centroid a step
            low = np.where(below >= 0, np.abs(x - self.values[dim, np.maximum(below, 0)]), far)
            high = np.where(above < k, np.abs(x - self.values[dim, np.minimum(above, k - 1)]), far)
            down = low <= high
            gap = np.minimum(low, high)
            number = self.order[dim, np.where(down, below, above)]
            below, above = below - down, above + ~down
            new = np.zeros_like(unseen)
            np.put_along_axis(new, number, True, axis=1)
            new &= unseen
            unseen &= ~new
            exact = np.full(new.shape, far)
            r, c = np.nonzero(new)
            exact[r, c] = ((x[r] - self.centroids[c]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)  # the smallest number among equals
            d = exact.min(axis=1)
            better = (d < distance[row]) | ((d == distance[row]) & (first < best[row]))
            best[row[better]], distance[row[better]] = first[better], d[better]
            go = ((gap ** 2).sum(axis=1) <= distance[row]) & unseen.any(axis=1)
            if not go.all():
                if not go.any():
                    break
                x, row, above, below, unseen = x[go], row[go], above[go], below[go], unseen[go]
        return best, distance


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of ``dims`` integers a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<int>) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("e", lambda x: F.floor(x * F.lit(float(scale))))
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
            .where((F.size("e") == dims) & ~bad)
            .select("vec_id", F.when(F.exists(whole, lambda i: (i > LARGEST) | (i < -LARGEST)),
                                     F.raise_error(F.lit("a component does not fit 64-bit distances")))
                    .otherwise(whole).cast("array<int>").alias("v")))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of ``<seed>:<vec_id>``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector joins its nearest centroid; the non-empty ones move to the
    floored means."""
    k, dims = centroids.shape

    def partial(batches):
        lists = CentroidLists(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            number, _ = lists.nearest(x)
            n += np.bincount(number, minlength=k)
            np.add.at(sums, number, x)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(n[full], pa.int64()), pa.array(list(sums[full]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(partial, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in totals.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]

    def run(batches):
        lists = CentroidLists(centroids)
        for batch in batches:
            number, distance = lists.nearest(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: str = SEED) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256 (of the cluster's final centroid)."""
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings, dims, scale), "centroid-vectors")
    centroids = first_centroids(vectors, k, seed)
    model = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        none = spark.createDataFrame([], "vec_id long, distance long, " + model)
        return none.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    out = stored(assigned(vectors, centroids), "centroid-assigned")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in sorted(inertia.items())]
    return (out.join(F.broadcast(spark.createDataFrame(rows, model)), "cluster")  # at most k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def oracle_sql() -> str:
    """The same for ``embeddings`` in DuckDB, by comparing every vector with every centroid."""
    rounds = ""
    for t in range(ROUNDS + 1):
        rounds += f""",
d{t} AS MATERIALIZED (SELECT r, c, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM p JOIN c{t} AS c USING (d) GROUP BY r, c),
a{t} AS MATERIALIZED (SELECT * FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
        if t < ROUNDS:
            rounds += f""",
m{t} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN p USING (r) GROUP BY c, d),
c{t + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{t} LEFT JOIN m{t} USING (c, d))"""
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range({DIMS})) AS d, unnest(v) AS x FROM e),
f AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
      FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e) QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, unnest(range({DIMS})) AS d, unnest(v) AS x FROM f){rounds}
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c) USING (c)
"""
