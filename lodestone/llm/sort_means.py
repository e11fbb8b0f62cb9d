"""Centroid clustering: sort-means over integer vectors, exact at every step.

Each round orders, for every centroid, all other centroids by their distance from it. A
vector starts at the centroid it had in the round before and meets the others in that
order; it stops as soon as the next one lies strictly beyond twice the vector's distance
from its former centroid, since by the triangle inequality neither that centroid nor any
later one can then be nearer or as near. All of it is integer arithmetic on squares
(``gap > 4 * distance``), so no rounding can cut a tie off.

A round is one map-side pass that writes vectors with their new centroid to the shared
folder, then one aggregation to at most k rows of exact sums. The driver holds k centroids,
whatever the number of vectors. No round shuffles vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise, new_path

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components beyond this size cannot be told apart by a squared distance that fits into a long.
LARGEST = 1 << 27
MOST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, v: floor(scale * x) of vectors with exactly dims components, none null, non-finite or beyond LARGEST."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(F.abs(c * scale) <= LARGEST, F.lit(False)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors of the k smallest hashes of `seed:key`, in their order; rows without a key never start."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.where(F.col("vec_id").isNotNull()).select(digest.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in best.collect()]  # k rows


class Ordered:
    """Centroids with, for each, the others from near to far."""

    def __init__(self, centroids: list[list[int]]):
        self.at = np.array(centroids, dtype=np.int64)
        apart = np.stack([((self.at - c) ** 2).sum(axis=1) for c in self.at])
        self.quarter = -(-apart // 4)  # quarter > d is the same as apart > 4 * d, without overflow
        self.order = [[j for j in np.argsort(row, kind="stable").tolist() if j != i] for i, row in enumerate(apart)]

    def assign(self, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row (ties: the smaller number), squared distance, and how many distances were computed."""
        own = rows - self.at[before]
        least = np.einsum("ij,ij->i", own, own)
        best, tried = before.copy(), len(rows)
        for c in np.unique(before).tolist():
            group = np.flatnonzero(before == c)
            group = group[np.argsort(-least[group], kind="stable")]
            from_former, here, near, found = -least[group], rows[group], least[group], best[group]
            for j in self.order[c]:
                n = int(np.searchsorted(from_former, -self.quarter[c, j], side="right"))  # the others have stopped
                if not n:
                    break
                gap = here[:n] - self.at[j]
                d = np.einsum("ij,ij->i", gap, gap)
                wins = (d < near[:n]) | ((d == near[:n]) & (j < found[:n]))
                near[:n][wins], found[:n][wins] = d[wins], j
                tried += n
            least[group], best[group] = near, found
        return best, least, tried


def assigned(rows: DataFrame, centroids: list[list[int]], keep_vectors: bool = True) -> DataFrame:
    """vec_id, v, cluster, distance of rows (vec_id, v, cluster as it was); without v if it is not kept."""
    ordered = Ordered(centroids)

    def run(batches):
        for b in batches:
            v = b.column(1)
            matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)
            best, least, _ = ordered.assign(matrix, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            cols = [b.column(0), v, pa.array(best, pa.int32()), pa.array(least, pa.int64())]
            names = ["vec_id", "v", "cluster", "distance"]
            at = [i for i in range(4) if keep_vectors or i != 1]
            yield pa.RecordBatch.from_arrays([cols[i] for i in at], [names[i] for i in at])

    kept = "v array<int>, " if keep_vectors else ""
    return rows.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id long, {kept}cluster int, distance long")


def means(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor(sum / count) of each cluster; a cluster without rows keeps its centroid."""
    dims = len(centroids[0])
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims))).collect()  # at most k rows
    moved = list(centroids)
    for r in sums:
        moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return moved


def sort_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every kept vector; the final centroids).

    Null, short, long, non-finite vectors, vectors with a null component and those with a
    component beyond LARGEST / scale are left out. Repeated keys and rows each count and
    come back once per row; equal hashes are ordered by vector. A null key is clustered and
    comes back null. Fewer than k vectors: as many centroids as there are vectors with a
    key; none: no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long"
    whole = whole_vectors(vectors, dims, scale, vector, key)
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        return spark.createDataFrame([], schema), []
    scratch = Scratch(spark)
    rows = whole.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        older = list(scratch.paths)
        rows = scratch.keep(assigned(rows, centroids), "clusters")
        for path in older:  # one table of vectors at a time, besides the one being written
            scratch.drop(path)
        centroids = means(rows, centroids)
    last = materialise(assigned(rows, centroids, keep_vectors=False), "assigned", new_path(spark, "assigned"))
    scratch.clear()
    return last, centroids


def query(spark, sf_dir: str) -> DataFrame:
    """op11: cluster, distance, inertia and centroid digest of every vector of embeddings."""
    rows, centroids = sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(c, min(MOST, s), min(MOST, sum(sums.values())), digest[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows are broadcast


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB: every vector against every centroid, round by round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims}),
x AS MATERIALIZED (SELECT rid, unnest(range({dims})) AS i, unnest(e) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT j, unnest(range({dims})) AS i, unnest(e) AS c
  FROM (SELECT e, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS j FROM v WHERE vec_id IS NOT NULL ORDER BY j LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, j := j)) AS best
  FROM (SELECT rid, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{r} USING (i) GROUP BY rid, j) GROUP BY rid)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c.j, c.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.c) AS c
  FROM c{r} c LEFT JOIN (SELECT best.j AS j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY 1, 2) m ON m.j = c.j AND m.i = c.i)"""
            )
    return f"""WITH {", ".join(steps)},
h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, CAST(best.j AS INTEGER) AS "cluster", best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN h ON h.j = best.j"""


SQL = _sql()
