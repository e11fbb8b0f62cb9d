"""An inverted-file index over vectors, stored as Parquet by cell: approximate top-k by codes, exact top-k with bounds.

Cells come from spherical k-means, trained by Spark on rows chosen by a hash (at most
TRAIN_ROWS a cell). Each cell's rows are stored in packs of about PACK: their keys, the
vectors as they are, and residual codes, one byte a dimension. Queries are packed by cell
in the same way, so a pack of queries meets a pack of vectors in one joined row and one
matrix product; a cell of any size is many packs, which any tasks may take.

search() reads the codes of a query's nearest cells, keeps its best few over all cells, and
scores only those on their vectors. How many cells that takes for a recall is measured when
the index is built. exact() finds the k nearest of the nearest cell first; their k-th score
bounds the rest, and by the triangle inequality between angles a cell whose centroid is
farther than the bound plus the cell's radius holds nothing better and is left out.

Null, empty and zero vectors, and those of another size than the index, score 0 with
everything; they stand in a cell of their own. Vectors without any structure (independent
directions in many dimensions) let no bound prune: there exact() compares all, in blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import get, kept, new_path, put
from .search import SEARCH_LIMIT, _matrix

#: Rows of a pack, rows a cell is trained on, rounds of training, most cells.
PACK, TRAIN_ROWS, TRAIN_ROUNDS, MOST_CELLS = 4096, 256, 6, 4096
#: Share of a calibration query's true neighbours that must lie in the cells it reads; number of such queries.
RECALL, CALIBRATION = 0.95, 64
#: The cell of vectors without a direction.
NOWHERE = -1
#: Queries of a pack that are compared with a pack at a time.
ASKED = 256
#: Cells a query is sent to together, and parts of the queries that meet a copy of such a tile's packs.
TILE_CELLS, TILE_PARTS = 16, 8
#: Room for rounding in comparisons of cosines.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """Where the packs are; centroids (unit rows), radius of each cell in radians, cells a query reads."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray
    probe: int
    nowhere: bool

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def packs(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """cell, chunk, keys, vectors, codes, steps; of some cells, only their folders are read."""
        rows = spark.read.schema("chunk int, keys array<long>, vectors binary, codes binary, steps binary, cell int").parquet(f"{self.path}/packs")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction are zero."""
    length = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return np.divide(m, length[:, None], out=np.zeros_like(m), where=good[:, None])


def _unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, dims)


# Building


def _train(rows: DataFrame, cells: int, dims: int, rounds: int) -> np.ndarray:
    """Centroids of spherical k-means; each round is one pass that returns sums by cell and dimension."""
    first = rows.orderBy(F.xxhash64("key"), "key").limit(cells).select("v").collect()  # a row a cell
    centroids = unit(np.array([r["v"] for r in first], dtype=np.float64).reshape(-1, dims))

    def sums(centroids):
        def run(batches):
            total, seen = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
            for b in batches:
                u = unit(_matrix(b.column(0), dims))
                own = (u @ centroids.T).argmax(axis=1)
                np.add.at(total, own, u)
                seen += np.bincount(own, minlength=len(centroids))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(at)), pa.int32()), pa.array(total[at].ravel())], ["cell", "i", "x"])

        return run

    for _ in range(rounds if len(centroids) > 1 else 0):
        moved = rows.select("v").mapInArrow(sums(centroids), "cell int, i int, x double").groupBy("cell", "i").agg(F.sum("x").alias("x")).collect()  # cells times dimensions
        total = np.zeros_like(centroids)
        for r in moved:
            total[r["cell"], r["i"]] = r["x"]
        seen = (total != 0).any(axis=1)
        centroids[seen] = unit(total[seen])
    return centroids


def _pack(dims: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        join = lambda c: b"".join(x.as_py() for x in table.column(c))
        return pa.table(
            {
                "cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "keys": pa.array([table.column("key").to_pylist()], pa.list_(pa.int64())),
                "vectors": pa.array([join("vector")], pa.binary()), "codes": pa.array([join("code")], pa.binary()), "steps": pa.array([join("step")], pa.binary()),
            }
        )

    return run


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, vector: str = "embedding", key: str = "vec_id", pack: int = PACK, recall: float | None = RECALL, k: int = SEARCH_LIMIT) -> VectorIndex:
    """Indexes every row with a key under `path`; the size is that of most vectors, the number of cells the root of the row count unless given.

    recall=None leaves the calibration out; the index then reads all cells.
    """
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-index")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dims, n = max(1, sizes[0]["size"]) if sizes else 1, rows.count()
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    fit = rows.where((F.size("v") == dims) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
    share = cells * TRAIN_ROWS / max(1, n)
    chosen = fit if share >= 1 else fit.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    centroids = _train(kept(chosen, "training"), cells, dims, TRAIN_ROUNDS)

    def assign(batches):
        for b in batches:
            m = _matrix(b.column(1), dims)
            m = np.where(np.isfinite(m), m, 0.0)
            u = unit(m)
            lost = ~u.any(axis=1)
            near = u @ centroids.T if len(centroids) else np.zeros((len(u), 1))
            cell = near.argmax(axis=1)
            residual = u - centroids[cell] if len(centroids) else u
            step = np.abs(residual).max(axis=1, initial=0) / 127
            code = np.rint(np.divide(residual, step[:, None], out=np.zeros_like(u), where=step[:, None] > 0)).astype(np.int8)
            angle = np.where(lost, 0.0, np.arccos(np.clip(near[np.arange(len(u)), cell], -1, 1)))
            cols = [
                b.column(0), pa.array(np.where(lost, NOWHERE, cell), pa.int32()), pa.array(angle), pa.array([x.tobytes() for x in m.astype("<f8")], pa.binary()),
                pa.array([x.tobytes() for x in code], pa.binary()), pa.array([x.tobytes() for x in step.astype("<f4")], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "cell", "angle", "vector", "code", "step"])

    placed = kept(rows.mapInArrow(assign, "key long, cell int, angle double, vector binary, code binary, step binary"), "placed")
    facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # a row a cell
    parts = spark.createDataFrame([(f["cell"], -(-f["n"] // pack)) for f in facts], "cell int, parts int")
    chunked = placed.join(F.broadcast(parts), "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))  # at most MOST_CELLS rows are broadcast
    packed = chunked.select("cell", "chunk", "key", "vector", "code", "step").groupBy("cell", "chunk").applyInArrow(_pack(dims), "cell int, chunk int, keys array<long>, vectors binary, codes binary, steps binary")
    packed.write.partitionBy("cell").parquet(f"{path}/packs")
    radii = np.zeros(len(centroids))
    for f in facts:
        if f["cell"] >= 0:
            radii[f["cell"]] = f["r"]
    index = VectorIndex(path, centroids, radii, len(centroids), any(f["cell"] == NOWHERE for f in facts))
    if recall is not None and len(centroids) > 1:
        index.probe = _calibrated(index, fit, recall, k)
    saved = {"centroids": index.centroids.tolist(), "radii": radii.tolist(), "probe": index.probe, "nowhere": index.nowhere, "dims": dims}
    put(spark, f"{path}/index.json", json.dumps(saved))
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index stored by build()."""
    saved = json.loads(get(spark, f"{path}/index.json"))
    centroids = np.array(saved["centroids"], dtype=np.float64).reshape(-1, saved["dims"])
    return VectorIndex(path, centroids, np.array(saved["radii"]), saved["probe"], saved["nowhere"])


def _calibrated(index: VectorIndex, fit: DataFrame, recall: float, k: int) -> int:
    """The least number of nearest cells that hold `recall` of the true neighbours of CALIBRATION indexed rows, by exact()."""
    asked = fit.orderBy(F.xxhash64("key", F.lit(2)), "key").limit(CALIBRATION).select("key", "v")
    asked = kept(asked, "calibration")
    at = {r["key"]: np.array(r["v"]) for r in asked.collect()}  # CALIBRATION rows
    hits = exact(index, asked, k, vector="v", key="key").select("query_id", "cell").collect()  # k rows each
    ranks = []
    for r in hits:
        if r["cell"] != NOWHERE:
            order = np.argsort(-(index.centroids @ unit(at[r["query_id"]][None])[0]), kind="stable")
            ranks.append(int(np.flatnonzero(order == r["cell"])[0]) + 1)
    ranks.sort()
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else len(index.centroids)


# Searching


def _asked(queries: DataFrame, index: VectorIndex, vector: str, key: str) -> DataFrame:
    return queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), *(c for c in ("bound", "done") if c in queries.columns))


@dataclass
class ByTile:
    """How _tiled() chooses."""

    choose: Callable


def _dealt(asked: DataFrame, index: VectorIndex, choose, most: int) -> DataFrame:
    """cell, ids, units, bounds: packs of queries, each query in the packs of the cells that choose(units, bounds, done) names.

    asked: query_id, v, bound, done (the cell that was searched already, or null). Given a ByTile, what _tiled() returns.
    """
    if isinstance(choose, ByTile):
        return _tiled(asked, index, choose.choose, most)
    dims = index.dims

    def run(batches):
        for b in batches:
            u = unit(np.nan_to_num(_matrix(b.column(1), dims), posinf=0, neginf=0))
            bounds = b.column(2).to_numpy(zero_copy_only=False)
            cells = choose(u, bounds, np.array([-2 if x is None else x for x in b.column(3).to_pylist()], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in u.astype("<f8")], pa.binary()), b.column(2), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "unit", "bound", "cells"])

    def pack(table: pa.Table) -> pa.Table:
        units = b"".join(x.as_py() for x in table.column("unit"))
        one = {"cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "ids": pa.array([table.column("query_id").to_pylist()], pa.list_(pa.int64()))}
        return pa.table({**one, "units": pa.array([units], pa.binary()), "bounds": pa.array([table.column("bound").to_pylist()], pa.list_(pa.float64()))})

    rows = asked.select("query_id", "v", "bound", "done").mapInArrow(run, "query_id long, unit binary, bound double, cells array<int>")
    parts = max(1, -(-most // PACK))  # a cell is asked by `most` queries at most
    spread = rows.select("query_id", "unit", "bound", F.explode("cells").alias("cell")).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    return spread.groupBy("cell", "chunk").applyInArrow(pack, "cell int, ids array<long>, units binary, bounds array<double>")


def _tiled(asked: DataFrame, index: VectorIndex, choose, most: int) -> DataFrame:
    """tile, part, ids, units, bounds, masks: packs of queries as in _dealt(), but a query is sent once to every TILE_CELLS cells.

    choose(units, bounds) gives a row of booleans a query, one a cell, and which queries ask the
    cell without directions. A mask's bits say which cells of the tile a query asks.
    """
    dims, tiles = index.dims, -(-len(index.centroids) // TILE_CELLS)

    def run(batches):
        for b in batches:
            u = unit(np.nan_to_num(_matrix(b.column(1), dims), posinf=0, neginf=0))
            open_, lost = choose(u, b.column(2).to_numpy(zero_copy_only=False))
            padded = np.zeros((len(u), tiles * TILE_CELLS), dtype=np.int32)
            padded[:, : open_.shape[1]] = open_
            masks = (padded.reshape(len(u), tiles, TILE_CELLS) << np.arange(TILE_CELLS, dtype=np.int32)).sum(axis=2)
            masks = np.column_stack([np.where(lost, 1 << NOWHERE % TILE_CELLS, 0), masks])  # the tile of NOWHERE is -1
            row, at = np.nonzero(masks)
            ends = pa.array(np.append(0, np.cumsum((masks > 0).sum(axis=1))).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at - 1, masks[row, at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in u.astype("<f8")], pa.binary()), b.column(2), *lists], ["query_id", "unit", "bound", "tiles", "masks"])

    def pack(table: pa.Table) -> pa.Table:
        first = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("tile", "part")}
        units = b"".join(x.as_py() for x in table.column("unit"))
        one = {**first, "ids": pa.array([table.column("query_id").to_pylist()], pa.list_(pa.int64())), "units": pa.array([units], pa.binary())}
        return pa.table({**one, "bounds": pa.array([table.column("bound").to_pylist()], pa.list_(pa.float64())), "masks": pa.array([table.column("mask").to_pylist()], pa.list_(pa.int32()))})

    rows = asked.select("query_id", "v", "bound").mapInArrow(run, "query_id long, unit binary, bound double, tiles array<int>, masks array<int>")
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-most // PACK)))).cast("int")
    spread = rows.select("query_id", "unit", "bound", chunk.alias("chunk"), F.inline(F.arrays_zip(F.col("tiles").alias("tile"), F.col("masks").alias("mask"))))
    spread = spread.toDF("query_id", "unit", "bound", "chunk", "tile", "mask").withColumn("part", F.pmod("chunk", F.lit(TILE_PARTS)))
    return spread.groupBy("tile", "part", "chunk").applyInArrow(pack, "tile int, part int, ids array<long>, units binary, bounds array<double>, masks array<int>")


def _best(index: VectorIndex, packs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, cell: of each pack of queries and pack of vectors each query's best k that reach its bound, exact.

    Single precision proposes, with room for its error; double precision decides, ties go to the smaller key.
    """
    dims, room = index.dims, index.dims * 2.4e-7

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell, ids, q = b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(), _unpack(b.column(2)[i].as_py(), dims)
                bounds, keys = b.column(3)[i].values.to_numpy(zero_copy_only=False), b.column(4)[i].values.to_numpy()
                if b.num_columns > 6:
                    asks = np.flatnonzero(b.column(6)[i].values.to_numpy() >> (cell % TILE_CELLS) & 1)
                    if not len(asks):
                        continue
                    ids, q, bounds = ids[asks], q[asks], bounds[asks]
                v = unit(_unpack(b.column(5)[i].as_py(), dims))
                v32, out = v.astype(np.float32).T.copy(), []
                for at in range(0, len(q), 256):
                    s = q[at : at + 256].astype(np.float32) @ v32
                    least = bounds[at : at + 256].astype(np.float64)
                    some = s[:, :1024]
                    if some.shape[1] > k + 1:  # the k + 1 best of some rows, one of which may be the query itself
                        low = np.partition(some, some.shape[1] - k - 1, axis=1)[:, some.shape[1] - k - 1]
                        least = np.maximum(least, low - room)
                    row, col = np.nonzero(s >= (least - room)[:, None])
                    other = ids[at + row] != keys[col]
                    row, col = row[other], col[other]
                    exact_ = np.einsum("ij,ij->i", q[at + row], v[col])
                    fits = exact_ >= bounds[at + row] - SLACK
                    row, col, exact_ = row[fits], col[fits], exact_[fits]
                    order = np.lexsort((keys[col], -exact_, row))
                    row, col, exact_ = row[order], col[order], exact_[order]
                    new = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
                    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
                    first = place < k
                    out.append((ids[at + row[first]], keys[col[first]], exact_[first]))
                a, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64()), pa.array(np.full(len(a), cell), pa.int32())], ["query_id", "vec_id", "score", "cell"])

    stored, columns = index.packs(packs.sparkSession).select("cell", "keys", "vectors"), ["cell", "ids", "units", "bounds", "keys", "vectors"]
    if "tile" in packs.columns:
        parts = F.explode(F.array(*map(F.lit, range(TILE_PARTS)))).alias("part")
        joined, columns = packs.join(stored.select("*", F.floor(F.col("cell") / TILE_CELLS).cast("int").alias("tile"), parts), ["tile", "part"]), [*columns, "masks"]
    else:
        joined = packs.join(stored, "cell")
    return joined.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double, cell int")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(index: VectorIndex, queries: DataFrame, k: int = SEARCH_LIMIT, least: float = -2.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, vec_id, score, cell, rank of the k nearest of each query, all with a score of at least `least`; a vector of the query's own key is left out.

    No result is lost: a cell is left out only where its best possible cosine is below the
    query's k-th score so far.
    """
    spark, centroids, radii = queries.sparkSession, index.centroids, index.radii
    count = queries.count()
    asked = _asked(queries, index, vector, key)

    def nearest(u, bounds, done):
        own = (u @ centroids.T).argmax(axis=1) if len(centroids) else np.full(len(u), NOWHERE)
        return [[int(c)] for c in own]

    start = asked.withColumn("bound", F.lit(float(least))).withColumn("done", F.lit(None).cast("int"))
    first = kept(_best(index, _dealt(start, index, nearest, count), k), "nearest-cell")
    top = _ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bound = F.when(F.col("n") >= k, F.greatest(F.col("low"), F.lit(float(least)))).otherwise(F.lit(float(least)))
    bounded = asked.join(top, "query_id", "left").select("query_id", "v", bound.alias("bound"), F.lit(None).cast("int").alias("done"))

    def others(u, bounds):
        if not len(centroids):
            return np.zeros((len(u), 0), dtype=bool), np.zeros(len(u), dtype=bool)
        near = u @ centroids.T
        angle = np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radii)
        possible = np.where(u.any(axis=1)[:, None], np.cos(angle), 0.0)
        open_ = possible >= bounds[:, None] - SLACK
        open_[np.arange(len(u)), near.argmax(axis=1)] = False  # searched already
        return open_, (bounds <= SLACK) & index.nowhere

    second = _best(index, _dealt(bounded, index, ByTile(others), count), k)
    return _ranked(first.unionByName(second), k)


def candidates(index: VectorIndex, queries: DataFrame, keep: int, probe: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, vec_id, cell, chunk, pos, about: of the codes in each query's nearest cells the best `keep`."""
    spark, centroids, dims = queries.sparkSession, index.centroids, index.dims
    probe = min(len(centroids), probe or index.probe)
    start = _asked(queries, index, vector, key).withColumn("bound", F.lit(-2.0)).withColumn("done", F.lit(None).cast("int"))
    nowhere = [NOWHERE] if index.nowhere else []

    def nearest(u, bounds, done):
        return [x.tolist() + nowhere for x in np.argsort(-(u @ centroids.T), axis=1, kind="stable")[:, :probe]]

    packs = _dealt(start, index, nearest, queries.count())

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell, ids, q = b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(), _unpack(b.column(2)[i].as_py(), dims)
                chunk, keys = b.column(3)[i].as_py(), b.column(4)[i].values.to_numpy()
                code = np.frombuffer(b.column(5)[i].as_py(), dtype=np.int8).reshape(-1, dims).astype(np.float32)
                code *= np.frombuffer(b.column(6)[i].as_py(), dtype="<f4")[:, None]
                middle = q @ centroids[cell] if cell >= 0 else np.zeros(len(q))
                n = min(keep, len(keys))
                for at in range(0, len(q), ASKED):
                    own = ids[at : at + ASKED]
                    about = (q[at : at + ASKED].astype(np.float32) @ code.T) + middle[at : at + ASKED].astype(np.float32)[:, None]
                    if cell < 0:
                        about[:] = 0
                    about[own[:, None] == keys[None, :]] = -3
                    col = np.argpartition(-about, n - 1, axis=1)[:, :n].ravel()
                    row = np.repeat(np.arange(len(own)), n)
                    cols = [pa.array(own[row], pa.int64()), pa.array(keys[col], pa.int64()), pa.array(np.full(len(row), cell), pa.int32()), pa.array(np.full(len(row), chunk), pa.int32()), pa.array(col, pa.int32()), pa.array(about[row, col].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "cell", "chunk", "pos", "about"])

    joined = packs.join(index.packs(spark).select("cell", "chunk", "keys", "codes", "steps"), "cell")
    found = joined.select("cell", "ids", "units", "chunk", "keys", "codes", "steps").mapInArrow(run, "query_id long, vec_id long, cell int, chunk int, pos int, about double")
    w = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    return found.where(F.col("about") > -3).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def search(index: VectorIndex, queries: DataFrame, k: int = SEARCH_LIMIT, probe: int | None = None, rescore: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, vec_id, score, rank: approximately the k nearest; scores are exact, rescore * k vectors a query are scored."""
    spark, dims = queries.sparkSession, index.dims
    asked = _asked(queries, index, vector, key)
    best = candidates(index, queries, rescore * k, probe, vector, key).join(asked, "query_id")
    grouped = best.groupBy("cell", "chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // PACK)))).alias("part")).agg(F.collect_list(F.struct("query_id", "pos", "v")).alias("asks"))  # at most rescore * k rows of some PACK queries

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                asks = b.column(0)[i].values
                keys, v = b.column(1)[i].values.to_numpy(), unit(_unpack(b.column(2)[i].as_py(), dims))
                pos, ids = asks.field("pos").to_numpy(), asks.field("query_id").to_numpy()
                q = unit(np.nan_to_num(_matrix(asks.field("v"), dims), posinf=0, neginf=0))
                scores = np.einsum("ij,ij->i", q, v[pos])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys[pos], pa.int64()), pa.array(scores)], ["query_id", "vec_id", "score"])

    joined = grouped.join(index.packs(spark).select("cell", "chunk", "keys", "vectors"), ["cell", "chunk"])
    return _ranked(joined.select("asks", "keys", "vectors").mapInArrow(run, "query_id long, vec_id long, score double"), k)
